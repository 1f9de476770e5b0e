"""Hash-chained log: each entry's keyed digest covers the digest stored before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256
from ..rules import tables as R

CHAINED = ["action", "actor_id", "actor_username", "detail_json", "entity_id", "entity_type", "ip_address", "occurred_at", "sequence", "user_agent"]


#: The escapes of a JSON string that have a letter.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _quoted(c: Column) -> Column:
    """A JSON string in which everything but printable ASCII is escaped; a character beyond 16 bits is two escapes."""
    escapes = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(....)", "\\\\u$1")
    one = lambda ch: F.coalesce(F.try_element_at(escapes, ch), F.when(ch.between(" ", "~"), ch).otherwise(units(ch)))
    text = F.when(c.rlike(r"^[ !#-\[\]-~]*\z"), c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), one), ""))
    return F.concat(F.lit('"'), text, F.lit('"'))


def canonical_event(rows: DataFrame) -> Column:
    """The entry as JSON with sorted names, no spaces and nulls kept."""
    parts = []
    for name in CHAINED:
        c = F.col(name)
        if name == "sequence":
            value = c.cast("string")
        elif name == "occurred_at":
            micro = F.date_format(c, "SSSSSS")
            value = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit('+00:00"'))
        else:
            value = F.when(c.isNull(), "null").otherwise(_quoted(c))
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def with_previous(rows: DataFrame, column: str = "hash", first: str = R.GENESIS, log: str | None = None) -> DataFrame:
    """rows with `stored`: the column's value in the entry before, by sequence; of its own log, where a column names several.

    A log is ordered as a whole, so ranges of it are linked apart: each range's last value is one row of a small table that
    gives the first entry of the next range its predecessor. No task sees more than one range of one log.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = rows.agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).first()
    if ends.a is None:
        return rows.withColumn("stored", F.lit(first))
    by = [log] if log else []
    width = max(1, -(-(ends.b - ends.a + 1) // n))
    ranged = rows.withColumn("range", F.floor((F.col("sequence") - F.lit(ends.a)) / width))
    lasts = ranged.groupBy(*by, "range").agg(F.max_by(column, "sequence").alias("last"))
    onward = Window.partitionBy(*by).orderBy("range")  # one row a range of a log
    lasts = lasts.select(*by, F.coalesce(F.lead("range").over(onward), F.lit(-1)).alias("range"), "last")
    inside = F.lag(column).over(Window.partitionBy(*by, "range").orderBy("sequence"))
    return ranged.join(lasts, [*by, "range"], "left").withColumn("stored", F.coalesce(inside, "last", F.lit(first))).drop("range", "last")


def verify(rows: DataFrame, secret: bytes, log: str | None = None) -> DataFrame:
    """entries, intact, first_broken_sequence (of each log, where a column names several). An entry is good if its stored
    predecessor is the one before it and its digest is that of the predecessor's digest and its own content."""
    linked = with_previous(rows, log=log)
    good = (F.col("prev_hash") == F.col("stored")) & (F.col("hash") == hmac_sha256(secret, F.concat("stored", canonical_event(linked))))
    found = F.count(F.lit(1)).alias("entries"), F.coalesce(F.min(F.when(~good, F.lit(0)).otherwise(1)), F.lit(1)).cast("boolean").alias("intact"), F.min(F.when(~good, F.col("sequence"))).alias("first_broken_sequence")
    return linked.groupBy(log).agg(*found) if log else linked.agg(*found)


def append(log: DataFrame, events: DataFrame, secret: bytes, by: str | None = None) -> DataFrame:
    """The log with a batch of events chained on, in order of time and event_key. Where a column `by` names several logs, each has
    a chain and numbers of its own.

    Each link depends on the one before, so a log's part of the batch passes one task, sorted by Spark, which may spill, one
    entry at a time; many logs are chained side by side. What is stored already is only asked for its logs' ends.
    """
    import hashlib
    import hmac

    import pyarrow as pa

    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    last = log.groupBy(key.alias("log_name")).agg(F.max("sequence").alias("last_sequence"), F.max_by("hash", "sequence").alias("last_hash"))
    fields = [f.name for f in log.schema.fields if f.name in events.columns and f.name not in ("prev_hash", "hash", "sequence")]
    # Each log's entries have to reach one task in their order. The window asks for that itself; a repartition would be left out
    # where a join before it deals by the log already, and that join may be carried out without dealing at all.
    chained_by = Window.partitionBy("log_name").orderBy("at_time", "event_key")
    begun = events.withColumns({"log_name": key, "at_time": F.col("occurred_at")}).join(last, "log_name", "left")
    numbered = begun.withColumn("sequence", F.coalesce("last_sequence", F.lit(0)).cast("long") + F.row_number().over(chained_by))
    ordered = numbered.select(*fields, "log_name", F.coalesce("last_hash", F.lit(R.GENESIS)).alias("last_hash"), "sequence", canonical_event(numbered).alias("canonical"))
    schema = ordered.select(*fields).schema.add("sequence", "long").add("prev_hash", "string").add("hash", "string")

    def fold(batches):
        current, before = None, ""
        for batch in batches:
            links, hashes = [], []
            for which, first, c in zip(*(batch.column(len(fields) + k).to_pylist() for k in (0, 1, 3)), strict=True):
                if current is None or which != current[0]:
                    current, before = (which,), first
                after = hmac.new(secret, (before + c).encode(), hashlib.sha256).hexdigest()
                links.append(before)
                hashes.append(after)
                before = after
            columns = [*batch.columns[: len(fields)], batch.column(len(fields) + 2), pa.array(links, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "sequence", "prev_hash", "hash"])

    chained = ordered.mapInArrow(fold, schema)
    return log.select(*schema.names).unionByName(chained)
