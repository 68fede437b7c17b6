"""Pluggable batch inference: labelling, encoding, verbalising, reconstructing.

Each surface takes a batch and is called from Arrow batches inside tasks. The
defaults need no network and no accelerator.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from echoframe.functions import constants as C
from echoframe.functions import text as T
from echoframe.functions.vectors import as_matrix
from echoframe.operators.aggregates import positions_by_document
from echoframe.operators.positions import DataCheckError
from echoframe.operators.sampling import sample_rows, seeded_hash

BROADCAST_LIMIT_BYTES = 64 << 20
DOCS_PER_BATCH = 256  # bounds an output batch of wide vectors

# ---- labelling providers --------------------------------------------------------

OK, REFUSED, EXHAUSTED = "ok", "refused", "retries exhausted"


class Provider:
    """Batch completion. ``None`` means gave up: the row is dropped."""

    def complete(self, prompts: Sequence[str]) -> list[str | None]:
        raise NotImplementedError

    def outcomes(self, prompts: Sequence[str]) -> list[tuple[str | None, str]]:
        """Completions with a status; providers that can refuse override this."""
        return [(c, OK if c is not None else EXHAUSTED) for c in self.complete(prompts)]

    def stream(self, chunks: Iterable[Sequence[str]]) -> Iterator[list[tuple[str | None, str]]]:
        """Outcomes of every chunk, in order. Providers that work ahead override this."""
        for prompts in chunks:
            yield self.outcomes(prompts) if prompts else []


class OfflineProvider(Provider):
    """Deterministic labels from the prompt itself: how the text opens, ends and how long it is.

    A text without any visible character is refused.
    """

    def outcomes(self, prompts: Sequence[str]) -> list[tuple[str | None, str]]:
        out: list[tuple[str | None, str]] = []
        for prompt in prompts:
            text = prompt.split("<begin_text>", 1)[-1].rsplit("<end_text>", 1)[0].replace("\n", " ")
            if not text.strip(" "):
                out.append((None, REFUSED))
                continue
            out.append(
                (
                    f"<analysis>\n- opens with: {text[:24]}\n\n2) about {len(text) // 100} hundred characters\n\n"
                    f"**Ends** on: {text[-24:]}\n</analysis>",
                    OK,
                )
            )
        return out

    def complete(self, prompts: Sequence[str]) -> list[str | None]:
        return [c for c, _ in self.outcomes(prompts)]


_PROVIDERS: dict[str, Callable[..., Provider]] = {"offline": OfflineProvider}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    _PROVIDERS[name] = factory


def resolve_provider(name: str, **options) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name!r}, expected one of {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](**options)


def provider_factory(provider: Provider | str) -> Callable[[], Provider]:
    """What a task calls to get its provider; an unknown name fails here, not in a task."""
    if isinstance(provider, str):
        resolve_provider(provider)
        return _PROVIDERS[provider]
    return lambda: provider


def complete(
    prompts: DataFrame, provider: Provider | str, prompt: str = "prompt", chunk_rows: int = C.CHUNK_ROWS
) -> DataFrame:
    """Replace ``prompt`` by ``raw`` and ``status``.

    The provider sees at most ``chunk_rows`` prompts at once, and as many chunks
    ahead as it asks for. A NULL prompt is not sent; its row passes through with a NULL status.
    """
    make = provider_factory(provider)
    kept = [f for f in prompts.schema.fields if f.name != prompt]
    schema = StructType([*kept, StructField("raw", StringType()), StructField("status", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = make()  # once per task, not per batch
        waiting: deque[tuple[pa.RecordBatch, list[str | None]]] = deque()

        def chunks() -> Iterator[list[str]]:
            for batch in batches:
                for start in range(0, batch.num_rows, chunk_rows):
                    part = batch.slice(start, chunk_rows)
                    texts = part.column(prompt).to_pylist()
                    waiting.append((part, texts))
                    yield [t for t in texts if t is not None]

        for answers in active.stream(chunks()):
            part, texts = waiting.popleft()
            asked = sum(t is not None for t in texts)
            if len(answers) != asked:
                raise DataCheckError(f"provider returned {len(answers)} completions for {asked} prompts")
            rest = iter(answers)
            rows = [next(rest) if t is not None else (None, None) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(f.name) for f in kept],
                    pa.array([r for r, _ in rows], pa.string()),
                    pa.array([s for _, s in rows], pa.string()),
                ],
                names=schema.names,
            )

    return prompts.mapInArrow(run, schema)


# ---- hashed bags of tokens ------------------------------------------------------


def token_bucket(token: Column, width: int) -> Column:
    """Hash bucket of a token: the leading 32 bits of its md5, modulo ``width``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % width).cast("int")


def token_buckets(tokens: Column, width: int) -> Column:
    return F.transform(tokens, lambda t: token_bucket(t, width))


def _list_array(flat: np.ndarray, widths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


# ---- encoder ----------------------------------------------------------------------


class Encoder:
    """One call per batch of documents: texts and 1-based positions in, vectors out.

    Returns per document an array (kept positions) and a matrix with one vector
    each; positions beyond the encoded length are left out.
    """

    def encode(
        self, texts: Sequence[str], positions: Sequence[np.ndarray]
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError


VECTOR_ROWS = "doc_id string, n_raw_tokens bigint, activation_vector array<float>, activation_layer bigint"


def _vector_batch(doc_ids: list, kept: list[np.ndarray], mats: list[np.ndarray], layer: int) -> pa.RecordBatch:
    counts = np.array([len(k) for k in kept])
    rows = int(counts.sum())
    width = max((m.shape[1] for m in mats if len(m)), default=0)
    flat = np.concatenate([m.reshape(-1) for m in mats]) if mats else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(doc_ids, dtype=object), counts), pa.string()),
            pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64()),
            _list_array(flat.astype(np.float32), np.full(rows, width), pa.float32()),
            pa.array(np.full(rows, layer), pa.int64()),
        ],
        names=["doc_id", "n_raw_tokens", "activation_vector", "activation_layer"],
    )


def pack(lengths: np.ndarray, budget: int, most: int = DOCS_PER_BATCH) -> list[np.ndarray]:
    """Batches of documents of about one length, whose padded size is at most ``budget`` tokens.

    Padded size is the longest length times the number of documents. A document
    longer than the budget is a batch of its own. Every document is in one batch.
    """
    order = np.argsort(-lengths, kind="stable")
    out, begin = [], 0
    while begin < len(order):
        room = max(1, min(most, budget // max(1, int(lengths[order[begin]]))))
        out.append(order[begin : begin + room])
        begin += room
    return out


def packing_report(positions: DataFrame, token_budget: int, max_length: int = C.MAX_LENGTH) -> DataFrame:
    """``n_docs, n_batches, n_tokens, n_padded, n_over``: what batches by budget cost; over are batches of several documents beyond it."""
    lengths = positions_by_document(positions).select(F.size(T.tokenize("longest_text", max_length)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(0), np.int64)
            packs = pack(n, token_budget)
            padded = [int(n[p].max()) * len(p) for p in packs]
            over = sum(size > token_budget and len(p) > 1 for size, p in zip(padded, packs, strict=True))
            sums = [len(n), len(packs), int(n.sum()), sum(padded), over]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=_PACKING)

    counted = lengths.mapInArrow(run, ", ".join(f"{c} bigint" for c in _PACKING))
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _PACKING])


_PACKING = ["n_docs", "n_batches", "n_tokens", "n_padded", "n_over"]


def encode(
    positions: DataFrame,
    d_model: int = 64,
    max_length: int = C.MAX_LENGTH,
    layer: int = 0,
    encoder: Encoder | None = None,
    clamp: bool = False,
    token_budget: int | None = None,
) -> DataFrame:
    """Vectors table: one pass per document on its longest prefix, one row per position.

    The default vector at a position counts the tokens up to it in hashed
    buckets. ``clamp`` moves positions beyond the encoded length to its end
    instead of leaving them out. With a ``token_budget`` an encoder gets batches
    of documents of about one length whose padded size is within it (``pack``).
    """
    docs = positions_by_document(positions)
    if encoder is not None:
        length = F.size(T.tokenize("longest_text", max_length)) if token_budget else F.lit(0)
        source = docs.select("doc_id", "positions", F.col("longest_text").alias("content"), length.alias("length"))
    else:
        buckets = token_buckets(T.tokenize("longest_text", max_length), d_model)
        source = docs.select("doc_id", "positions", buckets.alias("content"))

    def at(content: pa.Scalar, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bag = content.values.to_numpy(zero_copy_only=False)
        kept = places if clamp else places[places <= len(bag)]
        rows = [np.bincount(bag[:end], minlength=d_model) for end in kept]
        return kept, np.array(rows).reshape(len(kept), d_model)

    def parts(batch: pa.RecordBatch) -> list[np.ndarray]:
        if encoder is not None and token_budget:
            return pack(np.asarray(batch.column(3), np.int64), token_budget)
        return np.split(np.arange(batch.num_rows), range(DOCS_PER_BATCH, batch.num_rows, DOCS_PER_BATCH)) if batch.num_rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen in parts(batch):
                part = batch.take(pa.array(chosen))
                ids, wanted = part.column(0).to_pylist(), [np.asarray(p, np.int64) for p in part.column(1).to_pylist()]
                if encoder is None:
                    pairs = [at(content, places) for content, places in zip(part.column(2), wanted)]
                else:
                    pairs = encoder.encode(part.column(2).to_pylist(), wanted)
                    if len(pairs) != len(ids):
                        raise DataCheckError(f"encoder returned {len(pairs)} results for {len(ids)} documents")
                yield _vector_batch(ids, [k for k, _ in pairs], [m for _, m in pairs], layer)

    return source.mapInArrow(run, VECTOR_ROWS)


def encode_report(positions: DataFrame, max_length: int = C.MAX_LENGTH) -> DataFrame:
    """Positions that fit the encoded length and positions left out."""
    docs = positions_by_document(positions).select("positions", F.size(T.tokenize("longest_text", max_length)).alias("n"))
    beyond = F.size(F.filter("positions", lambda p: p > F.col("n")))
    return docs.agg(
        F.coalesce(F.sum(F.size("positions") - beyond), F.lit(0)).cast("bigint").alias("n_written"),
        F.coalesce(F.sum(beyond), F.lit(0)).cast("bigint").alias("n_skipped"),
    )


# ---- verbaliser -----------------------------------------------------------------


@dataclass(frozen=True)
class Codebook:
    """Described anchor vectors. Its size is a model parameter, like the number of weights."""

    texts: tuple[str, ...]
    matrix: np.ndarray  # unit rows

    def bytes(self) -> int:
        return self.matrix.nbytes + sum(len(t.encode()) for t in self.texts)


def fit_codebook(
    labelled: DataFrame,
    keys: Sequence[str],
    vector: str = "activation_vector",
    explanation: str = "api_explanation",
    size: int = 256,
    seed: int = C.SEED,
) -> Codebook:
    """``size`` labelled anchors in seeded order; they fit one broadcast by construction and check."""
    chosen = sample_rows(labelled, size, keys, seed).select(
        seeded_hash(seed, *keys).alias("h"), F.col(vector).cast("array<double>").alias("v"), F.col(explanation).alias("e")
    )
    rows = sorted(chosen.collect(), key=lambda r: r["h"])
    if not rows:
        raise DataCheckError("no labelled vectors for the codebook")
    m = np.array([r["v"] for r in rows], dtype=np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), C.NORM_FLOOR)
    book = Codebook(tuple(r["e"] for r in rows), m)
    if book.bytes() > BROADCAST_LIMIT_BYTES:
        raise DataCheckError(f"codebook of {book.bytes()} bytes is too large to send to every task")
    return book


def verbalise(
    vectors: DataFrame, codebook: Codebook, samples: int = 1, vector: str = "activation_vector"
) -> DataFrame:
    """Add ``sample_id`` and ``response``: descriptions of the nearest anchors, nearest first.

    Linear in the vectors: one product with the fixed-size codebook per batch.
    """
    if not 1 <= samples <= len(codebook.texts):
        raise ValueError(f"samples must be between 1 and {len(codebook.texts)}")
    spark = vectors.sparkSession
    matrix = codebook.matrix.T

    @F.arrow_udf("array<int>")
    def nearest(v: pa.Array) -> pa.Array:
        present, m = as_matrix(v)
        if len(m):
            sims = np.round(m @ matrix / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), C.NORM_FLOOR), 9)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :samples]
        else:
            best = np.zeros((0, samples))
        offsets = np.concatenate([[0], np.cumsum(np.where(present, samples, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(best.reshape(-1).astype(np.int32)), mask=pa.array(~present)
        )

    texts = spark.createDataFrame(list(enumerate(codebook.texts)), "_anchor int, _text string")
    spread = vectors.select("*", F.posexplode(nearest(F.col(vector))).alias("sample_id", "_anchor"))
    return (
        spread.join(F.broadcast(texts), "_anchor")
        .withColumn("response", T.wrap_explanation("_text"))
        .drop("_anchor", "_text")
    )


# ---- reconstructor --------------------------------------------------------------


def reconstruct_bag(explanation: str | Column, d_model: int = 64) -> Column:
    """Untrained reconstruction: hashed bag of the explanation's tokens; NULL stays NULL."""
    buckets = token_buckets(T.tokenize(explanation, None), d_model)

    @F.arrow_udf("array<float>")
    def bag(b: pa.Array) -> pa.Array:
        present, counts = _bag_matrix(b, d_model)
        offsets = np.concatenate([[0], np.cumsum(np.where(present, d_model, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(counts.reshape(-1).astype(np.float32)), mask=pa.array(~present)
        )

    return bag(buckets)


def _bag_matrix(buckets: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    present = np.asarray(buckets.is_valid())
    lists = buckets.drop_null()
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    counts = np.bincount(row * width + flat, minlength=len(lists) * width).reshape(len(lists), width)
    return present, counts.astype(np.float64)


@dataclass(frozen=True)
class RidgeReconstructor:
    """Linear map from hashed word counts (plus one) to a vector."""

    weights: np.ndarray  # (features + 1, d_model)

    def predict(self, explanation: str | Column) -> Column:
        weights, features = self.weights, self.weights.shape[0] - 1
        buckets = token_buckets(T.tokenize(explanation, None), features)

        @F.arrow_udf("array<float>")
        def apply(b: pa.Array) -> pa.Array:
            present, counts = _bag_matrix(b, features)
            rows = counts @ weights[:-1] + weights[-1]
            offsets = np.concatenate([[0], np.cumsum(np.where(present, weights.shape[1], 0))]).astype(np.int32)
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(rows.reshape(-1).astype(np.float32)), mask=pa.array(~present)
            )

        return apply(buckets)


def gram_sums(
    labelled: DataFrame, explanation: str, vector: str, features: int, d_model: int
) -> DataFrame:
    """One row with ``n`` and the sums of x x' and x y' (x = word counts and a one), in one pass.

    Each task folds its rows into one matrix of (features+1) x (features+1+d)
    numbers; the matrices are then added element by element in the JVM.
    """
    side, width = features + 1, features + 1 + d_model
    pairs = labelled.filter(F.col(explanation).isNotNull() & F.col(vector).isNotNull()).select(
        token_buckets(T.tokenize(explanation, None), features).alias("b"), F.col(vector).alias("v")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((side, width)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, counts = _bag_matrix(batch.column(0), features)
            _, y = as_matrix(batch.column(1))
            x = np.hstack([counts, np.ones((len(counts), 1))])
            total += x.T @ np.hstack([x, y])
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), _list_array(total.reshape(-1), np.array([side * width]), pa.float64())],
            names=["n", "gram"],
        )

    partial = pairs.mapInArrow(fold, "n bigint, gram array<double>")
    return partial.agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram")
    )


def fit_ridge(
    labelled: DataFrame,
    explanation: str = "api_explanation",
    vector: str = "activation_vector",
    features: int = 128,
    d_model: int = 64,
    penalty: float = 1.0,
) -> RidgeReconstructor:
    """Ridge fit. Only the summed matrices, whose size the two widths fix, reach the driver."""
    row = gram_sums(labelled, explanation, vector, features, d_model).first()
    if not row["n"]:
        raise DataCheckError("nothing to fit: no labelled vectors")
    side = features + 1
    gram = np.array(row["gram"]).reshape(side, side + d_model)
    ridge = penalty * np.eye(side)
    ridge[-1, -1] = 0.0  # the constant is not penalised
    return RidgeReconstructor(np.linalg.solve(gram[:, :side] + ridge + 1e-9 * np.eye(side), gram[:, side:]))
