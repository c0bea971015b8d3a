"""Secret candidates and a random forest that removes false findings; DataFrame functions only.

Candidates are all long runs of key characters, several to a word where there are. The forest sees a candidate's
length, its character classes and how often they change, how much of it the corpus' frequent
words cover, its path, and the words around it. It is trained on labelled findings: given
ones, or those that strict rules decide.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import picked, stored

MIN_LENGTH = 16
#: Labelled findings of each class that train the forest at most, those of least hash.
TRAIN_ROWS = 5_000
#: A word is of the dictionary if so many documents have it.
DICTIONARY_DOCS = 5
TREES, TREE_DEPTH, SEED = 20, 6, 17
_BINS = 8
_NAMES = r"(?i)(token|secret|passw|passwd|pwd|key|auth|credential)"
FEATURES = [
    "length", "digit_share", "upper_share", "hex_only", "transitions", "distinct_share", "covered",
    "named_before", "assigned", "quoted", "path_bin", "before_bin", "after_bin",
]


def _runs(min_length: int) -> str:
    """Key characters; an equals sign ends a key but does not stand inside one."""
    return rf"[A-Za-z0-9_+/.\-]{{{min_length},}}={{0,2}}"


def candidates(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Candidates of ``docs`` (_id, _text, _path) with their neighbours.

    Result: _id, _path, word (number in the text), run (number in the word), candidate, before2,
    before, after, raw.
    """
    pattern = _runs(min_length)
    words = F.split("_text", r"[\x20\x09-\x0D]+")
    near = lambda w, i: F.struct(
        i.alias("word"),
        w.alias("raw"),
        F.regexp_extract_all(w, F.lit(f"({pattern})"), F.lit(1)).alias("runs"),
        F.get("_words", i - 1).alias("before"),
        F.get("_words", i - 2).alias("before2"),
        F.get("_words", i + 1).alias("after"),
    )
    long = lambda w: (F.length(w) >= min_length) & w.rlike(pattern)
    docs = docs.withColumn("_words", words).filter(F.exists("_words", long))
    # only the few words that qualify get neighbours
    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: long(F.get("_words", i)))
    found = docs.select("_id", "_path", F.explode(F.transform(places, lambda i: near(F.get("_words", i), i))).alias("c"))
    each = found.select("_id", "_path", "c.*")
    return each.select(*[c for c in each.columns if c != "runs"], F.posexplode("runs").alias("run", "candidate"))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def _bin(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lower(column)), F.lit(_BINS)).cast("double")


def dictionary(docs: DataFrame, least: int) -> DataFrame:
    """Words of three letters or more that at least ``least`` documents have, in lower case."""
    words = F.array_distinct(F.split(F.lower("_text"), r"[^a-z]+"))
    held = docs.select(F.explode(F.filter(words, lambda w: F.length(w) >= 3)).alias("piece"))
    return held.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("piece")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the forest's features, one row per distinct candidate and neighbourhood."""
    pieces = found.select("candidate").distinct()
    pieces = pieces.select("candidate", F.explode(F.split(F.lower("candidate"), r"[^a-z]+")).alias("piece"))
    pieces = pieces.filter(F.length("piece") >= 3).join(words, "piece")
    covered = pieces.groupBy("candidate").agg(F.sum(F.length("piece")).alias("letters"))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    near = F.concat_ws(" ", "before2", "before", F.expr("substring_index(raw, candidate, 1)"))
    flag = lambda column: F.coalesce(column.cast("double"), F.lit(0.0))
    return found.join(covered, "candidate", "left").select(
        *[c for c in found.columns],
        F.length("candidate").cast("double").alias("length"),
        _share("[0-9]").alias("digit_share"),
        _share("[A-Z]").alias("upper_share"),
        flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"),
        (F.regexp_count("candidate", F.lit(change)) / F.length("candidate")).alias("transitions"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("distinct_share"),
        (F.coalesce("letters", F.lit(0)) / F.length("candidate")).alias("covered"),
        flag(near.rlike(_NAMES)).alias("named_before"),
        flag(near.rlike("[=:][\"']?$") | near.rlike("[=:] ")).alias("assigned"),
        flag(F.col("raw").rlike("[\"']")).alias("quoted"),
        F.coalesce(_bin("_path"), F.lit(0.0)).alias("path_bin"),
        F.coalesce(_bin("before"), F.lit(0.0)).alias("before_bin"),
        F.coalesce(_bin("after"), F.lit(0.0)).alias("after_bin"),
    )


def strict_label() -> Column:
    """Labels that need no judgement: 1 for named, assigned keys; 0 for numbers, hosts, plain words."""
    key = F.col("candidate").rlike("^([0-9a-f]{32,}|[A-Za-z0-9+/_-]{32,}={0,2}|AKIA[0-9A-Z]{16}|gh[pous]_[A-Za-z0-9]{36})$")
    sure = key & (F.col("named_before") > 0) & (F.col("assigned") > 0)
    number = F.col("candidate").rlike(r"^[0-9.\-/]+$")
    host = F.col("raw").rlike("@|https?:") | F.col("candidate").rlike(r"(?i)\.(com|org|net|html?)$")
    plain = (F.col("covered") > 0.6) & (F.col("digit_share") < 0.2)
    return F.when(sure, 1.0).when((number | host | plain) & (F.col("named_before") == 0), 0.0)


def secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    train_rows: int = TRAIN_ROWS,
    threshold: float = 0.5,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """Candidates of every text with the probability that they are secrets.

    ``labelled`` has candidate and label (1 secret, 0 not) and replaces the strict rules. Result:
    doc_id, word (number of the white-space word), run (number of the run in it), candidate_sha256,
    length, probability, kept. A candidate is a run of at least ``min_length`` key characters.
    Null and empty texts have no candidates; repeated rows each report theirs; a null path is a
    path of its own. If one class of labels is missing, all candidates keep the share of the
    other class as probability. Extra columns are left out.
    """
    docs = picked(docs, id_col, text_col, path_col).withColumnRenamed(f"_{path_col}", "_path")
    found = stored(featured(candidates(docs, min_length), dictionary(docs, DICTIONARY_DOCS)))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(found)
    if labelled is None:
        known = rows.withColumn("label", strict_label())
    else:
        known = rows.join(labelled.select("candidate", F.col("label").cast("double").alias("label")), "candidate")
    known = known.filter("label is not null").withColumn("_rank", F.xxhash64("candidate", "before", "after"))
    classes = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) == 2:
        parts = [known.filter(F.col("label") == k).orderBy("_rank", "candidate").limit(train_rows) for k in (0.0, 1.0)]
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED)
        model = forest.fit(parts[0].union(parts[1]).select("features", "label"))
        rows = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("p", F.lit(float(next(iter(classes), 0.0))))
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("word").cast("bigint").alias("word"), F.col("run").cast("bigint").alias("run"),
        F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("bigint").alias("length"),
        F.col("p").alias("probability"), (F.col("p") >= threshold).alias("kept"),
    )
