"""Raw exchange JSON (one text column) to market-data rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVELS = "array<array<string>>"
# Message type codes.
# Field letters of the messages.
_LETTERS = ("e", "E", "T", "s", "c", "v", "b", "a", "B", "A", "p", "P", "q", "t", "m")
_KINDS = {"24hrTicker": "ticker", "depthUpdate": "depth", "trade": "trade", "bookTicker": "book_ticker"}


def _number(c: Column) -> Column:
    """Text number; empty text is null."""
    return F.when(c != "", c.try_cast("double"))


def feed_normalise(df: DataFrame, raw: str = "value", received: str | None = None) -> DataFrame:
    """One schema for ticker, depth, trade and bookTicker messages in either envelope.

    Adds ``fault`` (null when the message is usable): text that is not JSON, or
    an unknown type.  Nothing is dropped; split on ``fault`` downstream.  The
    text is parsed once into a variant: its field names differ only in case,
    which a struct could not tell apart.
    """
    text = F.col(raw)
    base = df.withColumn("_doc", F.try_parse_json(text)).withColumn(
        "_stream", F.try_variant_get("_doc", "$.stream", "string")
    )
    wrapped = F.col("_stream").isNotNull()
    inner = F.try_variant_get("_doc", "$.data", "variant")
    base = base.withColumn("_body", F.when(wrapped, inner).otherwise(F.col("_doc")))
    # Each letter is looked up once, into a column of its own.
    base = base.withColumns({f"_f{i}": F.try_variant_get("_body", f"$.{n}", "string") for i, n in enumerate(_LETTERS)})

    def field(name: str) -> Column:
        return F.col(f"_f{_LETTERS.index(name)}")

    of_stream = (
        F.when(F.contains("_stream", F.lit("@ticker")), "ticker")
        .when(F.contains("_stream", F.lit("@depth")), "depth")
        .when(F.contains("_stream", F.lit("@trade")), "trade")
        .when(F.contains("_stream", F.lit("@bookTicker")), "book_ticker")
    )
    of_code = F.when(F.lit(False), "")
    for code, name in _KINDS.items():
        of_code = of_code.when(field("e") == code, name)
    base = base.withColumn("_kind", F.when(wrapped, of_stream).otherwise(of_code))
    kind = F.col("_kind")
    is_quote = kind.isin("ticker", "book_ticker")

    def levels(name: str, pick) -> Column:
        got = F.when(kind == "depth", F.try_variant_get("_body", f"$.{name}", _LEVELS))
        side = F.transform(got, lambda x: F.struct(x[0].try_cast("double").alias("p"), x[1].try_cast("double").alias("q")))
        return pick(F.filter(side, lambda x: x["q"] > 0))

    base = base.withColumns({"_bid": levels("b", F.array_max), "_ask": levels("a", F.array_min)})
    millis = F.when(kind == "trade", field("T")).otherwise(field("E")).try_cast("long")

    def quoted(letter: str, level: str) -> Column:
        return F.when(is_quote, _number(field(letter))).when(kind == "depth", F.col(level))

    out = {
        "symbol": F.upper(field("s")),
        "event_type": kind,
        "price": F.when(kind == "ticker", _number(field("c"))).when(kind == "trade", _number(field("p"))),
        "quantity": F.when(kind == "ticker", _number(field("v"))).when(kind == "trade", _number(field("q"))),
        "best_bid": quoted("b", "_bid.p"),
        "best_ask": quoted("a", "_ask.p"),
        "best_bid_qty": quoted("B", "_bid.q"),
        "best_ask_qty": quoted("A", "_ask.q"),
        "price_change_24h": F.when(kind == "ticker", _number(field("p"))),
        "price_change_percent_24h": F.when(kind == "ticker", _number(field("P"))),
        "trade_id": F.when(kind == "trade", field("t").try_cast("long")),
        "is_buyer_maker": F.when(kind == "trade", F.coalesce(field("m").try_cast("boolean"), F.lit(False))),
        "source_ts": F.timestamp_millis(millis),
        "fault": F.when(F.col("_doc").isNull(), "not json").when(kind.isNull(), "unknown type"),
    }
    if received:
        out["latency_ms"] = (F.unix_micros(F.col(received)) - millis * 1000) / F.lit(1000.0)
    made = base.withColumns(out)
    return made.select(*df.columns, *[c for c in out if c not in df.columns])


_COMMON = ("symbol", "message_type", "price", "volume", "bid_price", "ask_price", "trade_id", "side", "source")


def feed_normalise_multi_venue(
    df: DataFrame, raw: str = "value", venue: str = "venue", maker_true_is_buy: bool = False
) -> DataFrame:
    """Venue-specific messages to one schema.

    ``venue`` holds binance, coinbase, kraken or anything else (generic).  The
    first venue's maker flag says the buyer was passive, so the aggressor sold;
    ``maker_true_is_buy`` gives the opposite reading.
    """
    doc = F.col("_doc")

    def field(path: str) -> Column:
        return F.try_variant_get(doc, path if path.startswith("$") else f"$.{path}", "string")

    def number(path: str) -> Column:
        return field(path).try_cast("double")

    def whole(path: str) -> Column:
        return F.coalesce(F.floor(number(path)), F.lit(0)).cast("double")

    name = F.col(venue)
    stream, kind = field("stream"), field("type")
    maker = F.coalesce(field("data.m").try_cast("boolean"), F.lit(False))
    bought = maker if maker_true_is_buy else ~maker
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def rows(test: Column, label: str, **cols: Column) -> Column:
        made = {
            "symbol": none_s, "message_type": none_s, "price": none_d, "volume": none_d, "bid_price": none_d,
            "ask_price": none_d, "trade_id": none_s, "side": none_s,
        } | cols
        made["source"] = F.concat(name, F.lit(label))
        return F.when(test, F.struct(*[made[c].alias(c) for c in _COMMON]))

    first, second, third = name == "binance", name == "coinbase", name == "kraken"
    symbol = F.upper(field("data.s"))
    product = F.replace(field("product_id"), F.lit("-"), F.lit(""))
    message = F.coalesce(
        rows(
            first & F.contains(stream, F.lit("@ticker")), "_ticker", symbol=symbol, message_type=F.lit("quote"),
            price=number("data.c"), volume=whole("data.v"), bid_price=number("data.b"), ask_price=number("data.a"),
        ),
        rows(first & F.contains(stream, F.lit("@depth")), "_depth", symbol=symbol, message_type=F.lit("book_update")),
        rows(
            first & F.contains(stream, F.lit("@trade")), "_trade", symbol=symbol, message_type=F.lit("trade"),
            price=number("data.p"), volume=whole("data.q"), trade_id=field("data.t"),
            side=F.when(bought, "buy").otherwise("sell"),
        ),
        rows(
            second & (kind == "ticker"), "_ticker", symbol=product, message_type=F.lit("quote"), price=number("price"),
            volume=whole("volume_24h"), bid_price=number("best_bid"), ask_price=number("best_ask"),
        ),
        rows(
            second & (kind == "match"), "_trade", symbol=product, message_type=F.lit("trade"), price=number("price"),
            volume=whole("size"), trade_id=field("trade_id"),
            side=F.when(field("side") == "buy", "buy").otherwise("sell"),
        ),
        rows(
            third & field("$[1].c[0]").isNotNull(), "_ticker",
            symbol=F.replace(F.coalesce(field("$[3]"), F.lit("BTCUSD")), F.lit("/"), F.lit("")),
            message_type=F.lit("quote"), price=field("$[1].c[0]").try_cast("double"),
            bid_price=field("$[1].b[0]").try_cast("double"),
            ask_price=field("$[1].a[0]").try_cast("double"),
        ),
        rows(
            ~name.isin("binance", "coinbase", "kraken") & field("symbol").isNotNull(), "_generic",
            symbol=F.upper(field("symbol")), message_type=F.coalesce(kind, F.lit("unknown")), price=number("price"),
            volume=number("volume"), bid_price=number("bid"), ask_price=number("ask"),
        ),
    )
    return df.withColumn("_doc", F.try_parse_json(raw)).withColumn("_m", message).select(
        *df.columns, *[F.col(f"_m.{c}").alias(c) for c in _COMMON], F.col("_m").isNull().alias("unparsed")
    )
