"""Labelling: cached, deduplicated, resumable description of positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.operators.inference import Provider, complete
from echoframe.operators.marks import cannot_match, may_match, sketch, words_for
from echoframe.operators.positions import DataCheckError
from echoframe.session import materialize
from echoframe.sources.commits import commit, read_committed

KEYS = ("doc_id", "n_raw_tokens")
TEXT = "detokenized_text_truncated"
CACHED = "cached"


def skip_finished(positions: DataFrame, *finished: DataFrame, keys: Sequence[str] = KEYS, sketched: bool = False) -> DataFrame:
    """Rows whose key is in none of the finished tables.

    With ``sketched`` only the keys of rows that may be finished are moved, and
    whole only the few rows that a sketch takes for finished by chance, which is
    known from the keys. It reads both sides several times; give it stored
    tables. What it found about the keys is stored.
    """
    if sketched and finished:
        done = finished[0].select(*keys)
        for more in finished[1:]:
            done = done.unionByName(more.select(*keys))
        words = words_for(done.count())
        marks = materialize(sketch(done, keys, words), "done-marks")
        maybe = may_match(positions, marks, keys, words)
        open_ = materialize(maybe.select(*keys).join(done.distinct().hint("shuffle_hash"), list(keys), "left_anti"), "open-keys")
        chance = open_.select(*(F.col(k).alias(f"open_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"open_{k}")) for k in keys]  # a key with a null is equal to none that is finished
        return cannot_match(positions, marks, keys, words).unionByName(may_match(maybe, sketch(open_, keys), keys).join(chance, same, "left_semi"))
    for done in finished:
        positions = positions.join(done.select(*keys), list(keys), "left_anti")
    return positions


def distinct_texts(positions: DataFrame) -> DataFrame:
    """One row per text. Copies collapse before the shuffle, however many there are."""
    return positions.groupBy(T.text_key(TEXT).alias("text_sha256")).agg(F.any_value(TEXT).alias("text"))


def cache_lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached``: the stored explanation, NULL for a miss. Both sides are unique by key."""
    return texts.join(cache.select("text_sha256", F.col("explanation").alias("cached")), "text_sha256", "left")


def _asked(prompts: DataFrame, provider: Provider | str, pattern: str, chunk_rows: int, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``raw``, ``status`` and ``extracted`` of ``keep, prompt, cached``; a cached row passes by the provider."""
    cleaned = T.clean_list_markers(T.extract_answer("raw", pattern))
    return complete(prompts, provider, "prompt", chunk_rows).select(
        *keep, "raw", F.coalesce("status", F.lit(CACHED)).alias("status"), F.coalesce("cached", cleaned).alias("extracted")
    )


def attempt_labels(
    positions: DataFrame,
    provider: Provider | str = "offline",
    cache: DataFrame | None = None,
    template: str = C.INSTRUCTION_TEMPLATE,
    pattern: str = C.ANALYSIS_PATTERN,
    chunk_rows: int = C.CHUNK_ROWS,
) -> DataFrame:
    """Labels per distinct text: ``text_sha256, raw, status, extracted``.

    Only cache misses reach the provider, each text once; hits pass by it with
    status ``cached``. The cleaned result is written once, without the texts, so
    nothing downstream can call the provider again.
    """
    texts = distinct_texts(positions)
    looked = texts.withColumn("cached", F.lit(None).cast("string")) if cache is None else cache_lookup(texts, cache)
    prompts = looked.select(
        "text_sha256",
        "cached",
        F.when(F.col("cached").isNull(), T.instruction_prompt("text", template)).alias("prompt"),
    )
    return materialize(_asked(prompts, provider, pattern, chunk_rows, ["text_sha256"]), "label-attempts")


def answer_rows(
    positions: DataFrame,
    provider: Provider | str = "offline",
    template: str = C.INSTRUCTION_TEMPLATE,
    pattern: str = C.ANALYSIS_PATTERN,
    chunk_rows: int = C.CHUNK_ROWS,
    text: bool = True,
) -> DataFrame:
    """Every row of stored ``positions`` with ``text_sha256, raw, status, extracted``, written once; without the text on request.

    A text that comes once is asked where it lies and is not moved. Which texts
    come again is counted over their hashes and sketched in a broadcast of fixed
    size; only rows of these meet by text, so each text is still asked once. A
    row that the sketch takes for one of them by chance goes their way.
    """
    keep = [c for c in positions.columns if text or c != TEXT] + ["text_sha256"]
    return materialize(_answered(positions, keep, provider, template, pattern, chunk_rows), "label-rows")


def _answered(
    positions: DataFrame,
    keep: Sequence[str],
    provider: Provider | str = "offline",
    template: str = C.INSTRUCTION_TEMPLATE,
    pattern: str = C.ANALYSIS_PATTERN,
    chunk_rows: int = C.CHUNK_ROWS,
) -> DataFrame:
    """``keep``, ``raw``, ``status``, ``extracted`` of every row, to be read once: a reading of it asks."""
    hashed = positions.withColumns({"text_sha256": T.text_key(TEXT), "hash_": F.xxhash64(TEXT)})
    marks = sketch(hashed.groupBy("hash_").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["hash_"])
    alone, again = cannot_match(hashed, marks, ["hash_"]), may_match(hashed, marks, ["hash_"])
    prompts = alone.select(*keep, F.lit(None).cast("string").alias("cached"), T.instruction_prompt(TEXT, template).alias("prompt"))
    attempts = attempt_labels(again.select(*positions.columns), provider, None, template, pattern, chunk_rows)
    shared = again.select(*{*keep, "text_sha256"}).join(attempts, "text_sha256").select(*keep, "raw", "status", "extracted")
    return _asked(prompts, provider, pattern, chunk_rows, keep).unionByName(shared)


def attach_labels(
    positions: DataFrame, attempts: DataFrame, min_features: int = C.MIN_FEATURES
) -> DataFrame:
    """Explained table: positions whose text got a label with enough features.

    The label side is unique by key; a text shared by many positions makes one
    large left partition, which adaptive execution splits.
    """
    labels = attempts.filter(T.has_enough_features("extracted", min_features)).select(
        "text_sha256", F.col("extracted").alias("api_explanation")
    )
    keyed = positions.withColumn("text_sha256", T.text_key(TEXT))
    return keyed.join(labels, "text_sha256").select(*positions.columns, "api_explanation")


def audit(positions: DataFrame, attempts: DataFrame, min_features: int = C.MIN_FEATURES) -> DataFrame:
    """One record per position that was sent to the provider, with the reason if it was dropped."""
    keyed = positions.select(*KEYS, F.col(TEXT).alias("text"), T.text_key(TEXT).alias("text_sha256"))
    return _records(keyed.join(attempts, "text_sha256"), min_features)


def _records(tried: DataFrame, min_features: int) -> DataFrame:
    """Audit records of rows ``doc_id, n_raw_tokens, text, raw, status, extracted``."""
    reason = T.drop_reason("raw", "extracted", min_features)
    return tried.filter(F.col("status") != CACHED).withColumn("drop_reason", reason).select(
        *KEYS, "text", "raw", "extracted", F.col("drop_reason").isNotNull().alias("dropped"), "drop_reason", "status"
    )


def drop_summary(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Provider outcomes: refused, retries exhausted, ok."""
    return attempts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def check_some_kept(explained: DataFrame) -> None:
    if explained.limit(1).count() == 0:
        raise DataCheckError("all rows were dropped: responses did not match, or had too few features")


def label(
    positions: DataFrame, provider: Provider | str = "offline", cache: DataFrame | None = None, stored: bool = False, text: bool = True, **options
) -> DataFrame:
    """Explained table in one call; without ``text`` it has the key of the text in its place.

    Without a cache the positions are read several times and written first for
    that; say so where they are ``stored`` already.
    """
    min_features = options.pop("min_features", C.MIN_FEATURES)
    columns = [c if text or c != TEXT else "text_sha256" for c in positions.columns]
    if cache is None:
        rows = answer_rows(positions if stored else materialize(positions, "to-label"), provider, text=text, **options)
        kept = rows.filter(T.has_enough_features("extracted", min_features))
        return kept.select(*columns, F.col("extracted").alias("api_explanation"))
    explained = attach_labels(positions, attempt_labels(positions, provider, cache, **options), min_features)
    return explained if text else explained.withColumn("text_sha256", T.text_key(TEXT)).select(*columns, "api_explanation")


def label_into(
    spark: SparkSession,
    positions: DataFrame,
    path: str,
    provider: Provider | str = "offline",
    cache: DataFrame | None = None,
    slices: int = 1,
    retry_dropped: bool = False,
    require_kept: bool = True,
    stored: bool = False,
    **options,
) -> dict[str, int]:
    """Resumable labelling into ``explained`` and ``audit`` under ``path``.

    Progress is a key, not a row count: labelled rows and recorded drops are
    skipped, new rows are not. Work is done in ``slices`` by text hash; the
    labels and the audit records of a slice are one committed batch
    (``sources.commits``), so a crash loses at most one slice, whole, and copies
    of a text stay together. Of ``stored`` positions only those are moved that
    share their text, and none is written but into the two tables: the audit is
    written as the answers come, the labels are taken from it. ``labelled`` and
    ``audited`` read what is committed.
    A job that drops everything and finds no earlier label raises, its audit
    records kept, unless ``require_kept`` is off.
    """
    min_features = options.pop("min_features", C.MIN_FEATURES)
    written = {"explained": 0, "dropped": 0}
    for part in range(slices):
        finished = [labelled(spark, path)]
        if not retry_dropped:
            records = audited(spark, path)
            finished.append(None if records is None else records.filter("dropped"))
        own = positions if slices == 1 else positions.filter(F.pmod(F.xxhash64(TEXT), F.lit(slices)) == part)
        todo = skip_finished(own, *(t.select(*KEYS) for t in finished if t is not None), sketched=stored)
        alike = cache is None and set(todo.columns) == {*KEYS, TEXT}  # the audit holds all that the labels need
        if not (stored and alike):
            todo = materialize(todo, "label-todo")
        if todo.limit(1).count() == 0:
            continue
        if alike:
            records = _records(_answered(todo, [*KEYS, TEXT], provider, **options).withColumnRenamed(TEXT, "text"), min_features)
            names = [F.col("text").alias(TEXT) if c == TEXT else c for c in todo.columns]

            def explained(written: Mapping[str, DataFrame], names: Sequence[Column | str] = names) -> DataFrame:
                kept = written["audit"].filter(T.has_enough_features("extracted", min_features))
                return kept.select(*names, F.col("extracted").alias("api_explanation"))

        elif cache is None:
            rows = answer_rows(todo, provider, **options)
            explained = rows.filter(T.has_enough_features("extracted", min_features)).select(*todo.columns, F.col("extracted").alias("api_explanation"))
            records = _records(rows.withColumnRenamed(TEXT, "text"), min_features)
        else:
            attempts = attempt_labels(todo, provider, cache, **options)
            explained = attach_labels(todo, attempts, min_features)
            records = materialize(audit(todo, attempts, min_features), "label-audit")
        record = commit(
            spark, path, {"audit": records, "explained": explained}, lambda written: {"dropped": written["audit"].filter("dropped").count()}
        )
        written["explained"] += record["rows"]["explained"]
        written["dropped"] += record["facts"]["dropped"]
    if require_kept and written["dropped"] and not written["explained"]:
        check_some_kept(labelled(spark, path))
    return written


def labelled(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed explained rows of a labelling job, or None."""
    return read_committed(spark, path, "explained")


def audited(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed audit records of a labelling job, or None."""
    return read_committed(spark, path, "audit")
