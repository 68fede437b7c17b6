"""Merkle manifest of a dataset, kept as a log of nodes in postorder.

Rows of a source, by id, are the leaves of a tree of runs of 16; the roots of
the sources are the leaves of the last tree. A tree is appended to its log in
the order in which nodes are complete: a node directly behind the last of its
children, and the cut-off nodes of the right edge at the end. The place of any
node then follows from its level, its number and the number of leaves alone
(``postorder``), so nothing in the log points anywhere.

Builders are aligned: one holds 16**3 neighbouring nodes and writes the three
levels above them, and the next round goes on with the builders' last nodes,
4096 times fewer. A source of any size is so many builders, never one task.
Proofs are taken the other way: from the top, a builder's part of the log and
the one path above it give the siblings of all its nodes by their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from echoframe.operators.sampling import natural_rank
from echoframe.session import materialize, new_table_path

BITS = 4
ARITY = 1 << BITS
#: Levels that a builder writes, and so 16**3 nodes that it reads.
LEVELS = 3
SPAN = BITS * LEVELS
_MOST = 60 // BITS

LOG = "tree long, n long, level int, idx long, pos long, digest string, top boolean, doc_id long, claim string"
PATHS = "tree long, idx long, left array<string>, right array<string>, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nodes_at(level: int, n: int) -> int:
    return (n + (1 << BITS * level) - 1) >> (BITS * level)


def height(n: int) -> int:
    """Level of the root over ``n`` leaves."""
    level = 0
    while nodes_at(level, n) > 1:
        level += 1
    return level


def postorder(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes in the log of a tree of ``n`` leaves.

    A whole node is complete with leaf ``m - 1``, the last one below it: before
    it stand the nodes of its level and below that are whole by then, and those
    above that were whole before this leaf. Cut-off nodes follow all whole ones, level by level.
    """
    m = (np.asarray(idx, np.int64) + 1) << (BITS * level)
    place = sum((m if j <= level else m - 1) >> (BITS * j) for j in range(_MOST)) - 1
    whole = sum(n >> (BITS * j) for j in range(_MOST))
    cut = sum(n % (1 << BITS * j) > 0 for j in range(1, level))
    return np.where(m <= n, place, whole + cut)


# ---- leaves ---------------------------------------------------------------------


def framed(value: Column) -> Column:
    """Length in bytes, a colon and the value, or a dash for null: no two rows give one string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(framed(v) for v in values)), 256)


def place_leaves(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``tree, n, idx`` added to ``source, doc_id, leaf, claim``: the source's number, its leaves and the row's place among them.
    Besides, the leaves of the largest source.

    Rows are range-partitioned by source and id, so a large source is many
    partitions; a place is the row's own in its partition and what earlier
    partitions hold of the source, a count per partition and source.
    """
    stored = materialize(leaves.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    keys = ("source", "doc_id", "leaf", "tie")  # equal rows are many keys, too
    placed = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "merkle-placed").withColumn("part", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counted = placed.groupBy("part", "source").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.withColumn("shift", F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first"))
    sources = natural_rank(counted.groupBy("source").agg(F.sum("c").alias("n")), ["source"], "tree")
    numbered = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("part", "o.source", "shift", "tree", "n")
    numbered = materialize(numbered, "merkle-offsets").alias("o")
    most = numbered.agg(F.max("n")).first()[0] or 0
    leaves = placed.alias("p").join(numbered, (F.col("p.part") == F.col("o.part")) & F.col("p.source").eqNullSafe(F.col("o.source"))).select(
        "tree", "n", (F.col("row") + F.col("shift")).alias("idx"), "doc_id", F.col("leaf").alias("digest"), "claim"
    )
    return leaves, most


# ---- the log ----------------------------------------------------------------------


def _builder(base: int) -> Callable[[pa.Table], pa.Table]:
    """Reads neighbouring nodes of level ``base``; writes the levels above them, with the leaves in the first round."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, n, first = (table.column(c)[0].as_py() for c in ("tree", "n", "idx"))
        digests = table.column("digest").to_pylist()
        parts = [(base, first, digests)] if base == 0 else []
        level = base
        while level < base + LEVELS and nodes_at(level, n) > 1:
            digests = [digest_of(*digests[k : k + ARITY]) for k in range(0, len(digests), ARITY)]
            first, level = first >> BITS, level + 1
            parts.append((level, first, digests))
        count = [len(d) for _, _, d in parts]
        levels = np.repeat([p[0] for p in parts], count)
        idx = np.concatenate([np.arange(f, f + len(d)) for _, f, d in parts])
        pos = np.concatenate([postorder(lv, np.arange(f, f + len(d)), n) for lv, f, d in parts])
        rows = len(idx)
        spare = lambda c, kind: pa.concat_arrays([table.column(c).combine_chunks().cast(kind), pa.nulls(rows - len(table), kind)]) if base == 0 else pa.nulls(rows, kind)
        out = pa.table({
            "tree": np.full(rows, tree), "n": np.full(rows, n), "level": levels.astype(np.int32), "idx": idx, "pos": pos,
            "digest": pa.array([d for p in parts for d in p[2]], pa.string()), "top": np.repeat([nodes_at(p[0], n) == 1 for p in parts], count),
            "doc_id": spare("doc_id", pa.int64()), "claim": spare("claim", pa.string()),
        })
        return out.sort_by("pos")

    return build


@dataclass(frozen=True)
class Log:
    """Logs of one or many trees, a table per round of builders."""

    rounds: tuple[DataFrame, ...]

    @property
    def nodes(self) -> DataFrame:
        """``tree, n, level, idx, pos, digest, top, doc_id, claim`` of every node; ``tree, pos`` is its address."""
        out = self.rounds[0]
        for r in self.rounds[1:]:
            out = out.union(r)
        return out

    @property
    def tops(self) -> DataFrame:
        return self.nodes.filter("top").select("tree", "n", "digest")


def build_log(leaves: DataFrame, most: int, path: str) -> Log:
    """Logs of the trees over ``tree, n, idx, digest, doc_id, claim``, of up to ``most`` leaves; stored under ``path``."""
    spark = leaves.sparkSession
    rounds: list[DataFrame] = []
    nodes, base = leaves, 0
    while True:
        at = f"{path}/from-level={base}"
        keyed = nodes.select(*leaves.columns, F.shiftright("idx", SPAN).alias("block"))
        keyed.groupBy("tree", "block").applyInArrow(_builder(base), LOG).write.parquet(at)
        rounds.append(spark.read.schema(LOG).parquet(at))
        base += LEVELS
        if nodes_at(base, most) == 1:
            return Log(tuple(rounds))
        nodes = rounds[-1].filter((F.col("level") == base) & ~F.col("top")).select(*leaves.columns)


# ---- proofs -----------------------------------------------------------------------


def _opener(base: int, prove: bool) -> Callable[[pa.Table], pa.Table]:
    """Reads a builder's nodes of levels ``base`` and up, and the path above it; gives paths of its lowest nodes, or folds their claims."""

    def open_(table: pa.Table) -> pa.Table:
        above = table.filter(pc.is_null(table.column("pos"))).to_pylist()[0]
        table = table.filter(pc.is_valid(table.column("pos"))).sort_by("pos")
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        places, digests = np.asarray(table.column("pos")), table.column("digest").to_pylist()
        lowest = table.filter(pc.equal(table.column("level"), base)).sort_by("idx")
        first, count = lowest.column("idx")[0].as_py(), len(lowest)

        top = min(base + LEVELS, height(n))
        paths = {first >> (BITS * (top - base)): (above["left"], above["right"])}
        for level in range(top - 1, base - 1, -1):  # the path of a node is that of its parent behind its own siblings
            shift = BITS * (level - base)
            low, high = first >> shift, (first + count - 1) >> shift
            at = np.searchsorted(places, postorder(level, np.arange(low, high + 1), n)).tolist()
            below = {}
            for begin in range(low, high + 1, ARITY):
                run = [digests[at[k - low]] for k in range(begin, min(begin + ARITY, high + 1))]
                left, right = paths[begin >> BITS]
                for k in range(len(run)):
                    below[begin + k] = (["".join(run[:k]), *left], ["".join(run[k + 1 :]), *right])
            paths = below
        if not prove:
            left, right = zip(*(paths[first + k] for k in range(count)), strict=True)
            same = lambda v: pa.array([v] * count, pa.string())
            return pa.table({
                "tree": np.full(count, tree), "idx": np.arange(first, first + count), "left": pa.array(left, pa.list_(pa.string())),
                "right": pa.array(right, pa.list_(pa.string())), "subroot": same(above["subroot"]), "root": same(above["root"]),
            })
        proofs, folded = [], []
        for k, claim in enumerate(lowest.column("claim").to_pylist()):
            left, right = paths[first + k]
            proofs.append(digest_of(*(x for both in zip(left, right, strict=True) for x in both)))
            for a, b in zip(left, right, strict=True):
                claim = digest_of(a, claim, b)
            folded.append(claim)
        return pa.table({
            "doc_id": lowest.column("doc_id"), "leaf": lowest.column("digest"), "subroot": pa.array([above["subroot"]] * count, pa.string()),
            "root": pa.array([above["root"]] * count, pa.string()), "proof_sha256": proofs, "folded_root": folded,
        })

    return open_


def open_log(log: Log, above: DataFrame, prove: bool) -> DataFrame:
    """From the paths ``tree, n, left, right, subroot, root`` above whole trees down to their leaves.

    A row per leaf: its path, or with ``prove`` its proof and what its claim folds to.
    """
    last = len(log.rounds) - 1
    paths = None
    for k in range(last, -1, -1):
        base = k * LEVELS
        # trees that end in this round, and builders whose last node the round above has opened
        ends = above.filter(F.col("n") <= F.lit(1 << SPAN * (k + 1)))
        if k:
            ends = ends.filter(F.col("n") > F.lit(1 << SPAN * k))
        upper = ends.select("tree", F.lit(0).cast("long").alias("block"), "left", "right", "subroot", "root")
        if paths is not None:
            upper = upper.union(paths.select("tree", F.col("idx").alias("block"), "left", "right", "subroot", "root"))
        nodes = log.rounds[k] if not k else log.rounds[k].union(log.rounds[k - 1].filter((F.col("level") == base) & ~F.col("top")))
        nodes = nodes.filter(F.col("level") < base + LEVELS).withColumn(
            "block", F.expr(f"shiftright(idx, {BITS} * ({base + LEVELS} - level))")
        )
        rows = nodes.unionByName(upper, allowMissingColumns=True)
        paths = rows.groupBy("tree", "block").applyInArrow(_opener(base, prove and not k), PROOFS if prove and not k else PATHS)
    return paths


# ---- manifest ----------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    sources: Log
    whole: Log


def build(docs: DataFrame, path: str, claim: Column | None = None) -> Manifest | None:
    """The logs of ``doc_id, source, lang, n_chars, text``, stored under ``path``; None for an empty table.

    Leaves of a source go by id, rows without one first, rows of one id by
    their digests; equal rows are a leaf each. ``claim`` is a digest per row to
    check against the manifest, its own leaf where none is given. Other columns are not read.
    """
    spark = docs.sparkSession
    own = leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    leaves = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("leaf"), (own if claim is None else claim).alias("claim")
    )
    placed, most = place_leaves(leaves)
    if not most:
        return None
    sources = build_log(placed, most, f"{path}/sources")
    tops = sources.tops
    n = tops.count()
    none = F.lit(None)
    over = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("tree").alias("idx"), none.cast("long").alias("doc_id"),
                       "digest", none.cast("string").alias("claim"))
    return Manifest(sources, build_log(over, n, f"{path}/whole"))


def proofs(manifest: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf."""
    empty = F.array().cast("array<string>")
    root = manifest.whole.tops.select(
        "tree", "n", empty.alias("left"), empty.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    paths = open_log(manifest.whole, root, prove=False).select(F.col("idx").alias("tree"), "left", "right", "root")
    above = manifest.sources.tops.withColumnRenamed("digest", "subroot").join(paths, "tree")
    return open_log(manifest.sources, above, prove=True).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_proofs(docs: DataFrame, path: str | None = None, claim: Column | None = None) -> DataFrame:
    """Build and check at once: a row per document, no rows for an empty table.

    Null values are leaves of their own kind, as is an empty text; very long
    texts are hashed where they are read and never moved.
    """
    spark: SparkSession = docs.sparkSession
    manifest = build(docs, path or new_table_path(spark, "manifest"), claim)
    if manifest is None:
        return spark.createDataFrame([], PROOFS + ", verified boolean")
    return proofs(manifest)


# ---- SQL -----------------------------------------------------------------------------


def _sql_tree(name: str, nodes: str, rounds: int) -> list[str]:
    """Runs of all levels of the trees over ``nodes`` (``tree, idx, digest``); a tree of one node stays as it is."""
    out = [f"{name}_0 AS (SELECT tree, idx, digest, count(*) OVER (PARTITION BY tree) AS c FROM {nodes})"]
    for k in range(rounds):
        out.append(
            f"{name}_run_{k} AS (SELECT tree, idx // {ARITY} AS idx, any_value(c) AS c, list(digest ORDER BY idx) AS run FROM {name}_{k} GROUP BY tree, idx // {ARITY})"
        )
        up = f"CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest"
        out.append(f"{name}_{k + 1} AS (SELECT tree, idx, (c + {ARITY - 1}) // {ARITY} AS c, {up} FROM {name}_run_{k})")
    return out


def proofs_sql(rounds: int = 5, top_rounds: int = 2) -> str:
    """``manifest_proofs`` over ``documents`` in DuckDB SQL, for up to 16**rounds rows of a source and 16**top_rounds sources.

    The claim lower-cases the text where 5 divides the crc32 of the id.
    """
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, x: xor(s >> 1, 3988292384 * (s & 1)))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        framed = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(framed)})"

    ctes = [
        f"""d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf("text")} AS digest,
          CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim FROM documents)""",
        "l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM d)",
        *_sql_tree("s", "l", rounds),
        f"tops AS (SELECT 0 AS tree, tree AS idx, digest FROM s_{rounds})",
        *_sql_tree("w", "tops", top_rounds),
        "fold_0 AS (SELECT doc_id, tree, idx, digest, claim AS folded, '' AS proof FROM l)",
    ]
    levels = [("s", k, "f.tree", "f.idx") for k in range(rounds)] + [("w", k, "0", "f.tree") for k in range(top_rounds)]
    for j, (name, k, tree, idx) in enumerate(levels):
        at = f"({idx} // {ARITY**k} % {ARITY})"
        left, right = f"array_to_string(r.run[1:{at}], '')", f"array_to_string(r.run[{at} + 2:], '')"
        ctes.append(
            f"""fold_{j + 1} AS (SELECT f.* REPLACE (CASE WHEN r.c = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded,
          CASE WHEN r.c = 1 THEN proof ELSE proof || {left} || {right} END AS proof)
          FROM fold_{j} f JOIN {name}_run_{k} r ON r.tree = {tree} AND r.idx = {idx} // {ARITY ** (k + 1)})"""
        )
    return "WITH " + ",\n".join(ctes) + f"""
    SELECT f.doc_id, f.digest AS leaf, t.digest AS subroot, w.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = w.digest AS verified
    FROM fold_{len(levels)} f JOIN tops t ON t.idx = f.tree CROSS JOIN w_{top_rounds} w"""
