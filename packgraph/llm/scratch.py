"""Bounded-size helpers over written tables, and columns of input tables picked by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.scratch import Scratch, shared_root

__all__ = ["Scratch", "binned", "mark", "numbered", "only", "plain", "shared_root", "with_texts"]

#: Bins of a numbered group: each bin is one sort, so a group of n rows is numbered in pieces of about n / BINS.
BINS = 1024
REPEATS = 1 << 16  # rows alike in all columns that one task writes
OFFSETS = 1 << 20  # counts that are broadcast, about 30 MB; more of them are joined


def binned(df: DataFrame, order: list[str], bins: int = BINS) -> DataFrame:
    """df with the bin (column __bin) of each row by the hash of its order columns."""
    return df.withColumn("__bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, scratch: Scratch) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... without bringing a group into one task, the same under any partitioning.

    Rows alike in all columns are counted as one row first. A row's bin comes from the hash of its order columns, which must tell
    rows apart that are not alike. Bins are sorted on their own, and the counts of (group, bin) become offsets. At last the rows
    that were counted as one take numbers in a row, many of them in several tasks.
    """
    counted = binned(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")), order)
    counted = scratch.put(f"counted-{out}", counted)
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = counted.withColumn("__at", before(Window.partitionBy(*group, "__bin").orderBy(*order)))
    sizes = counted.groupBy(*group, "__bin").agg(F.sum("__n").alias("__n"))
    offsets = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__bin").alias("__b"), before(Window.partitionBy(*group).orderBy("__bin")).alias("__off"))
    offsets = scratch.put(f"offsets-{out}", offsets)
    on: Column = F.col("__bin") == F.col("__b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    placed = local.join(F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets, on).withColumn("__at", F.col("__at") + F.col("__off")).select(*df.columns, "__at", "__n")
    many = placed.filter(F.col("__n") > REPEATS).withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(REPEATS).cast("long"))))
    many = many.repartition("__at", "__from").select(*df.columns, (F.col("__at") + F.col("__from")).alias("__at"), F.least(F.lit(REPEATS), F.col("__n") - F.col("__from")).alias("__n"))
    each = placed.filter(F.col("__n") <= REPEATS).unionByName(many)
    return each.select(*df.columns, F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("__n") - 1)).alias(out))


def plain(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, cast to the wanted types, so that further or clashing columns don't matter.

    A name is matched exactly first, then without regard to case; a column that is not there counts as null.
    Names that occur twice mean the first of them.
    """
    names = df.columns
    positional = df.toDF(*[f"__c{i}" for i in range(len(names))])
    picked = []
    for name, kind in wanted.items():
        at = next((i for i, n in enumerate(names) if n == name), next((i for i, n in enumerate(names) if n.lower() == name.lower()), None))
        picked.append((F.lit(None) if at is None else F.col(f"__c{at}")).cast(kind).alias(name))
    return positional.select(*picked)


def with_texts(docs: DataFrame, make):
    """The rows of docs whose text passes, with all their columns, filtered where they are.

    ``make()`` is called once in each task and returns a function from a list of texts (bytes or None) to a list of
    booleans. Column names may clash: the first column named text is meant.
    """
    names = docs.columns
    at = next((i for i, n in enumerate(names) if n == "text"), next((i for i, n in enumerate(names) if n.lower() == "text"), None))
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def kept(batches):
        import pyarrow as pa

        verdict = make()
        for batch in batches:
            texts = [None] * batch.num_rows if at is None else batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(verdict(texts), pa.bool_()))

    return safe.mapInArrow(kept, safe.schema).toDF(*names)


def mark(text: str = "text"):
    """A hash that tells rows of one doc_id apart if their texts differ."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and mark are in kept (columns doc_id, mark), with all their columns; of rows that repeat
    both, one. Only these texts' rows are dealt out by doc_id; kept is small columns."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = plain(docs, doc_id="long", text="string").columns  # the columns that plain() picks, by place
    at = {w: next((i for i, n in enumerate(names) if n == w), next((i for i, n in enumerate(names) if n.lower() == w), None)) for w in own}
    pick = lambda w, kind: (F.lit(None) if at[w] is None else F.col(f"c{at[w]}")).cast(kind)
    keyed = safe.withColumns({"__id": F.coalesce(pick("doc_id", "long"), F.lit(0)), "__none": pick("doc_id", "long").isNull(), "__mark": F.xxhash64(F.coalesce(pick("text", "string"), F.lit("")))})
    keys = kept.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("mark").alias("__mark"))
    on = ["__id", "__none", "__mark"]
    repeated = not keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    found = keyed.join(keys.distinct(), on, "left_semi")
    return (found.dropDuplicates(on) if repeated else found).drop(*on).toDF(*names)
