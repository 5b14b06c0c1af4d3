"""Document fingerprints: a canonical exact digest, on DataFrame functions only.

The canonical form of a text is its Unicode compatibility composition (NFKC), case
folded, with every run of white space taken as one space and the ends trimmed. The
digest is three independently seeded 64-bit xxhash values of that form. Documents
that fall into one digest bucket are compared byte by byte with the bucket's smallest
document; one whose canonical bytes differ gets ``~`` and the SHA-512 of its canonical
bytes as a suffix, and so never shares a fingerprint with different bytes.

Joins of tables that grow with the documents shuffle at every size.

Likeness of two exact digests is 1.0 for equal canonical forms and 0.0 otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, partitions, read_table

_NORMALIZER = "com.ibm.icu.text.Normalizer"
_CHARACTER = "com.ibm.icu.lang.UCharacter"
# White space of the Unicode White_Space property.
_BLANKS = "[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, single spaces, trimmed; plain ASCII skips the Unicode steps."""
    composed = F.reflect(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(_CHARACTER), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(_NORMALIZER), F.lit("compose"), folded, F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)
    form = F.when(ascii_only, F.lower(text)).otherwise(again)
    return F.trim(F.regexp_replace(form, _BLANKS, " "))


def digest(form: Column) -> Column:
    """192 bits: three seeded 64-bit hashes, as 48 hexadecimal digits.

    ``form`` should be a column that holds the canonical form, so that it is made once.
    """
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), form))), 16, "0") for seed in (11, 23, 47)])


def next_ids(docs: DataFrame, work: Workspace, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, longest, next_id) of every distinct id of (doc_id, n_chars): its rows, the
    most characters of one, and the next id in ascending order, after the last the first.

    Ids are range-partitioned once and stored with their range, so that every step below
    sees the same borders; only one row per range (not per document) crosses ranges, so
    no task holds all ids. Null ids are left out.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    counted = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    ranged = work.table(counted.repartitionByRange(n, id_col).withColumn("_range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("_range").agg(F.min(id_col).alias("_head"))
    # at most one row per range from here on: bounded by the number of partitions
    heads = work.table(heads, "heads")
    ring = heads.withColumn("_after", F.lead("_head").over(Window.orderBy("_range")))
    first = heads.agg(F.min("_head").alias("_first"))
    ring = ring.crossJoin(F.broadcast(first)).select("_range", F.coalesce("_after", "_first").alias("_after"))
    led = ranged.withColumn("_next", F.lead(id_col).over(Window.partitionBy("_range").orderBy(id_col)))
    return led.join(F.broadcast(ring), "_range").select(id_col, "n", "longest", F.coalesce("_next", "_after").alias("next_id"))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to any table with a text column (a column of that name is replaced).

    Null text counts as empty. Rows are independent: ties and repeated rows get equal
    fingerprints, long texts are read whole, an empty table gives no rows.
    """
    held = docs.withColumn("_canonical", canonical(F.coalesce(F.col(text), F.lit(""))))
    return held.withColumn("fingerprint", digest(F.col("_canonical"))).drop("_canonical")


def copies(docs: DataFrame, prints: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, row, class_id, differs): byte comparison inside equal buckets.

    ``docs`` has doc_id, row (a hash of the text) and text, ``prints`` doc_id, row and
    fingerprint. Only documents of buckets with more than one member are compared, each
    with the bucket's smallest document. ``differs`` is empty where the bytes are the
    same; other documents of the bucket form classes by a SHA-512 of their bytes.
    """
    prints = prints.select("doc_id", "row", "fingerprint").distinct()
    smallest = F.min(F.struct("doc_id", "row")).alias("rep")
    buckets = prints.groupBy("fingerprint").agg(smallest, F.count("*").alias("n")).filter("n > 1")
    # a table of its own: adaptive execution can then split a large bucket's rows in the join
    buckets = work.table(buckets.select("fingerprint", "rep"), "buckets")
    members = work.table(prints.join(buckets.hint("merge"), "fingerprint").select("doc_id", "row", "rep"), "members")
    form = docs.join(members.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "rep", canonical(F.col("text")).alias("form"))
    own = work.table(form.dropDuplicates(["doc_id", "row"]), "bytes")
    reps = own.filter((F.col("doc_id") == F.col("rep.doc_id")) & (F.col("row") == F.col("rep.row"))).select("rep", F.col("form").alias("rep_form"))
    differs = F.when(F.col("form") == F.col("rep_form"), F.lit("")).otherwise(F.concat(F.lit("~"), F.sha2("form", 512)))
    compared = work.table(own.join(reps.hint("merge"), "rep").select("doc_id", "row", "rep", differs.alias("differs")), "compared")
    odd = compared.filter("differs <> ''").groupBy("rep", "differs").agg(F.min("doc_id").alias("least"))
    same = compared.filter("differs = ''").select("doc_id", "row", F.col("rep.doc_id").alias("class_id"), "differs")
    return same.unionByName(compared.join(odd, ["rep", "differs"]).select("doc_id", "row", F.col("least").alias("class_id"), "differs"))


def _one_each(table: DataFrame, value: str) -> DataFrame:
    """One row an id: repeated ids are stood for by their row of least text hash."""
    return table.groupBy("doc_id").agg(F.min_by(value, "row").alias(value))


def fingerprint_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many
    (or all) of the next document. Null texts count as empty; long texts are read whole.
    A repeated doc_id gives a row for each of its rows, all with the same next document; as
    a next document it is stood for by its row of least text hash. Rows without doc_id are
    left out. Equal texts are ties in every column but the next document's. An empty table
    gives no rows; further columns are ignored, whatever their names.
    """
    work = Workspace(spark, "fingerprints")
    text = F.coalesce("text", F.lit(""))
    # texts go by doc_id once: both joins below see the same columns, so Spark shuffles for one and reads that again for the other
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("doc_id is not null")
    row = F.xxhash64("text").alias("row")
    base = texts.select("doc_id", "text", row)
    links = work.table(next_ids(base.select("doc_id", F.char_length("text").alias("n_chars")), work), "next")
    repeated = not links.filter("n > 1").isEmpty()
    # what each document lends to the one before it
    wanted = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), F.floor(F.col("longest") / 4).cast("int").alias("k"))
    lent = (_one_each(base, "text") if repeated else texts).join(wanted.hint("merge"), "doc_id")
    lent = lent.select(F.col("to_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, k)").alias("following"))
    k = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.expr("concat(substring(text, 1, char_length(text) - k), substring(following, 1, k))")
    joined = texts.join(lent.hint("merge"), "doc_id").withColumn("k", k).select("doc_id", row, "next_id", "text", edited.alias("edited"))
    forms = joined.select(
        "doc_id",
        "row",
        "next_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("_form"),
        canonical(F.col("edited")).alias("_edited_form"),
    )
    prints = work.table(
        forms.select("doc_id", "row", "next_id", "n_chars", "edited_sha256", digest(F.col("_form")).alias("fingerprint"), digest(F.col("_edited_form")).alias("edited_fingerprint")),
        "prints",
    )
    compared = copies(base, prints, work)
    own = prints.join(compared.hint("merge"), ["doc_id", "row"], "left").withColumn("fingerprint", F.concat("fingerprint", F.coalesce("differs", F.lit(""))))
    own = work.table(own, "own")
    following = _one_each(own, "fingerprint") if repeated else own
    own = own.join(following.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("next_fingerprint")).hint("merge"), "next_id")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    result = work.table(
        own.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            like("fingerprint", "edited_fingerprint").alias("near_edited"),
            like("fingerprint", "next_fingerprint").alias("near_next"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
        ),
        "result",
    )
    work.keep(result)
    return result


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents``: see fingerprint_report, also for the odd cases."""
    return fingerprint_report(spark, read_table(spark, sf_dir, "documents"))
