"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, so tokens are labelled first: words, and
beginnings of words, far more frequent in toxic than in clean documents are
candidates, and a greedy cover takes those that explain toxic documents which
those taken before do not.  Their occurrences in toxic documents are the toxic tokens, all others clean.  A
two-label chain is fitted to the whole texts of the sample (features: the word, its
first four and six and its last four letters; transitions between labels).  Forward-backward over
whole texts gives each token's toxic marginal; the marginals of a document
aggregate to its score by statistics that do not grow with its length, calibrated
on the labelled sample, and tokens above 0.5 are the offending spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.shared import materialise, small_batches, tidied

#: At most about so many labelled documents of each label are fitted, with their whole texts.
FIT_DOCS = 600
STEPS = 40
#: A unit is telling if its log-likelihood ratio is at least this share of the log of the number of units.
CHANCE = 0.7
#: Words over which a document's toxic words are spread when its score is taken.
PRIOR_WORDS = 50
_SLICE_BYTES = 1 << 20
_CHUNK = 128
#: Words whose factor is remembered within a partition, twice over: those of late and those before; longer words are not remembered.
_REMEMBERED = 120_000
_LONGEST = 64
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def token(word: bytes) -> str:
    """The word lower-cased, without what is neither letter nor digit at its ends."""
    if word.isalpha():  # ASCII letters alone
        return word.lower().decode()
    text = word.decode("utf-8", "replace")
    start, end = 0, len(text)
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return text[start:end].lower()


def features(word: str) -> tuple[str, str, str, str]:
    """One feature of each kind: the word, its first four and six letters, its last four."""
    return word, word[:4], word[:6], word[-4:]


def units(word: str) -> set[str]:
    """What may mark a token as toxic: the word itself (ended by a blank) or its beginnings of 4 to 6 letters."""
    return {word + " ", *(word[:k] for k in (4, 5, 6) if len(word) >= k)} if word else set()


def _tokens(text: bytes | None) -> list[str]:
    return [token(w) for w in (text or b"").split()]


class _Factors(dict):
    """The factor by which each word speaks for toxic, worked out at first sight.

    When it is full, what it holds becomes the older half and what the older
    half held is forgotten; words met again move back.
    """

    def __init__(self, weights: list[dict[str, float]], bias: float):
        super().__init__()
        self.weights, self.bias, self.older = weights, bias, {}

    def __missing__(self, word: bytes) -> float:
        value = self.older.get(word)
        if value is None:
            whole = token(word)
            a, b, c, d = self.weights
            total = self.bias + a.get(whole, 0.0) + b.get(whole[:4], 0.0) + c.get(whole[:6], 0.0) + d.get(whole[-4:], 0.0)
            value = math.exp(min(30.0, max(-30.0, total)))
        if len(word) <= _LONGEST:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > _REMEMBERED:
            self.older = dict(self)
            self.clear()


class Chain:
    """Weights of the chain: per kind of feature (toxic against clean), bias and log transition factors."""

    def __init__(self, weights: list[dict[str, float]], bias: float, moves: np.ndarray, calibration: tuple[float, ...]):
        self.weights, self.bias, self.moves, self.calibration = weights, bias, moves, calibration
        self.known: _Factors | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def marginals(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The toxic marginal of every word of every text."""
        if self.known is None:
            self.known = _Factors(self.weights, self.bias)
        self.known.trim()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        x = np.fromiter(map(self.known.__getitem__, chained.from_iterable(texts)), np.float64, int(sizes.sum()))
        p = chain_marginals(x, sizes, np.exp(self.moves))
        return np.split(p, np.cumsum(sizes)[:-1]) if len(texts) else []

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-min(40.0, max(-40.0, float(np.dot(self.calibration, summary(p))))))))


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's marginals say, none of which grows with its length; and 1.

    The root of the toxic words' density, smoothed by ``PRIOR_WORDS`` clean words
    for the sake of short texts, and the mean of the highest marginals, one for each ``PRIOR_WORDS`` words begun.
    """
    if not len(p):
        return np.array([0.0, 0.0, 1.0])
    top = -(-len(p) // PRIOR_WORDS)
    return np.array([math.sqrt(p.sum() / (len(p) + PRIOR_WORDS)), np.partition(p, len(p) - top)[-top:].mean(), 1.0])


def chain_marginals(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
    """Marginals of label 1 in independent chains laid end to end (see ``chain_messages``)."""
    fore, back = chain_messages(x, sizes, a, chunk)
    both = fore * back
    return both[:, 1] / both.sum(1)


def chain_messages(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, chunk: int = _CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The forward and backward messages at every token of independent chains laid end to end.

    x: each token's factor for label 1; a[i, j]: factor of a move from i to j.
    The forward message holds the token's own factor, the backward one does not.
    Chains are cut into chunks: all chunks compute their transfer matrices side
    by side, the chunks of a chain are linked in order, and all chunks are run
    through once more with what enters them; long chains cost no more than short.
    """
    if not len(x):
        return np.empty((0, 2)), np.empty((0, 2))
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(sizes)), parts)
    rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[owner] + rank * chunk
    length = np.minimum(chunk, sizes[owner] - rank * chunk)
    by = np.argsort(-length, kind="stable")
    begin, length, owner, rank = begin[by], length[by], owner[by], rank[by]
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    place = np.empty((int(parts.max()), len(sizes)), np.int64)
    place.fill(-1)
    place[rank, owner] = np.arange(len(begin))

    def step(v: np.ndarray, t: np.ndarray, first: np.ndarray | None, forward: bool) -> np.ndarray:
        """One token further; v: (..., 2) messages, rows of chunks."""
        shape = (-1,) + (1,) * (v.ndim - 2)
        f = x[t].reshape(shape)
        if forward:
            zero, one = a[0, 0] * v[..., 0] + a[1, 0] * v[..., 1], f * (a[0, 1] * v[..., 0] + a[1, 1] * v[..., 1])
            if first is not None and first.any():
                zero[first], one[first] = v[first][..., 0], f[first] * v[first][..., 1]
        else:
            w = f * v[..., 1]
            zero, one = a[0, 0] * v[..., 0] + a[0, 1] * w, a[1, 0] * v[..., 0] + a[1, 1] * w
        return np.stack([zero, one], -1)

    def norm(v: np.ndarray) -> np.ndarray:
        return v / v.reshape(len(v), -1).sum(1).reshape((-1,) + (1,) * (v.ndim - 1))

    single = int(parts.max()) == 1
    heads = rank == 0
    ahead, behind = np.full((len(begin), 2), 1.0), np.full((len(begin), 2), 1.0)
    if not single:
        for forward, enter in ((True, ahead), (False, behind)):
            m = np.tile(np.eye(2), (len(begin), 1, 1))
            for k in range(len(active)):
                n = active[k]
                t = begin[:n] + (k if forward else length[:n] - 1 - k)
                m[:n] = norm(step(m[:n], t, heads[:n] if forward and k == 0 else None, forward))
            order = range(place.shape[0]) if forward else range(place.shape[0] - 1, -1, -1)
            for r in order:
                now = place[r]
                then = place[r - 1] if forward and r else place[r + 1] if not forward and r + 1 < place.shape[0] else None
                if then is None:
                    continue
                both = (now >= 0) & (then >= 0)
                v = enter[then[both]]
                enter[now[both]] = norm(np.einsum("nij,ni->nj", m[then[both]], v))
    alpha, beta = ahead.copy(), behind.copy()
    fore, back = np.empty((len(x), 2)), np.empty((len(x), 2))
    for k in range(len(active)):
        n = active[k]
        t = begin[:n] + k
        alpha[:n] = norm(step(alpha[:n], t, heads[:n] if k == 0 else None, True))
        fore[t] = alpha[:n]
        t = begin[:n] + length[:n] - 1 - k
        back[t] = beta[:n]
        beta[:n] = norm(step(beta[:n], t, None, False))
    return fore, back


def pair_marginals(fore: np.ndarray, back: np.ndarray, x: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected number of moves (0,0), (0,1), (1,0), (1,1) over all chains."""
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    right = back[at] * np.stack([np.ones(len(at)), x[at]], -1)
    both = fore[at - 1][:, :, None] * a[None] * right[:, None, :]
    return (both / both.sum((1, 2), keepdims=True)).sum(0).ravel()


def fit_chain(texts: list[tuple[list[str], list[int]]], steps: int = STEPS, ridge: float = 0.02, rate: float = 0.3) -> tuple[list[dict[str, float]], float, np.ndarray]:
    """Maximum conditional likelihood with a ridge, by Adam steps over all texts."""
    index: dict[tuple[int, str], int] = {}
    words: dict[str, int] = {}
    name = np.fromiter((words.setdefault(w, len(words)) for t, _ in texts for w in t), np.int64)
    own = np.array([[index.setdefault((k, f), len(index)) for k, f in enumerate(features(w))] for w in words], np.int64)
    y = np.fromiter((v for _, marks in texts for v in marks), np.float64)
    sizes = np.array([len(t) for t, _ in texts], np.int64)
    inner = np.ones(len(y), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    n = len(index)
    theta = np.zeros(n + 5)
    theta[n] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    before, after = y[:-1][inner[1:]], y[1:][inner[1:]]
    seen = np.array([((before == i) & (after == j)).sum() for i in (0, 1) for j in (0, 1)], np.float64)
    for k in range(1, steps + 1):
        moves = np.exp(theta[n + 1 :].reshape(2, 2))
        x = np.exp(np.clip(theta[n] + theta[own].sum(1), -30, 30))[name]
        fore, back = chain_messages(x, sizes, moves)
        both = fore * back
        gap = y - both[:, 1] / both.sum(1)
        by_word = np.bincount(name, weights=gap, minlength=len(words))
        by_feature = np.bincount(own.ravel(), weights=np.repeat(by_word, own.shape[1]), minlength=n)
        grad = np.concatenate([by_feature, [gap.sum()], seen - pair_marginals(fore, back, x, sizes, moves)])
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights: list[dict[str, float]] = [{}, {}, {}, {}]
    for (kind, f), i in index.items():
        if abs(theta[i]) > 1e-3:
            weights[kind][f] = float(theta[i])
    return weights, float(theta[n]), theta[n + 1 :].reshape(2, 2)


def _calibrate(rows: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of the label on the summary, by Newton steps with a small ridge."""
    w = np.zeros(rows.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(len(w))
        move = np.linalg.solve(hess, rows.T @ (y - p) - 0.05 * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(x) for x in w)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(text, toxic) of at most about ``fit_docs`` documents of each label, written to the shared folder.

    The labels' rows whose hash is below a threshold are chosen first; that
    bounded list is broadcast to the documents.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    space = 1 << 30
    limit = F.lit(0)
    for value, n in sorted(sizes.items()):
        limit = F.when(F.col("toxic") == value, F.lit(int(space * min(1.0, fit_docs / n)))).otherwise(limit)
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < limit)
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    return materialise(texts.join(F.broadcast(marks), F.col("_id") == F.col("doc_id")).select("text", F.col("toxic").cast("int").alias("toxic")))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = sorted(set().union(*map(units, set(_tokens(text)))))
            yield pa.RecordBatch.from_pydict({"unit": pa.array(found, pa.string()), "toxic": pa.array([toxic] * len(found), pa.int32())})


def _one_sided(c1: int, c0: int, share: float) -> float:
    """Log-likelihood ratio of c1 of c1 + c0 against a binomial of ``share``."""
    n = c1 + c0
    return c1 * math.log(c1 / n / share) + (c0 * math.log(c0 / n / (1 - share)) if c0 else 0.0)


def toxic_units(sample: DataFrame) -> set[str]:
    """The words and beginnings whose tokens in toxic documents are labelled toxic; the sample's size bounds them."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return set()
    counts = sample.mapInArrow(_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    lift = ((F.col("c1") + 0.1) / n1) / ((F.col("c0") + 0.1) / n0)
    found = counts.filter((F.col("c1") >= 2) & (lift >= 4)).collect()
    # of so many units few should be this one-sided by chance
    bar, share = CHANCE * math.log(max(2, counts.count())), n1 / (n1 + n0)
    found = [r for r in found if _one_sided(r["c1"], r["c0"], share) >= bar]
    seen = {r["unit"]: r["c1"] for r in sorted(found, key=lambda r: (-r["c1"], r["unit"]))}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set().union(*map(units, set(_tokens(t)))) & seen.keys()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"units": pa.array(own, pa.list_(pa.string()))})

    held = [set(r["units"]) for r in sample.filter("toxic = 1").select("text").mapInArrow(holding, "units array<string>").collect()]
    chosen: set[str] = set()
    open_ = [h for h in held if h]
    need = max(2, len(held) // 100)
    while open_:
        gain: dict[str, int] = {}
        for h in open_:
            for u in h:
                gain[u] = gain.get(u, 0) + 1
        unit = min(gain, key=lambda u: (-gain[u], u))
        if gain[unit] < need:
            break
        chosen.add(unit)
        open_ = [h for h in open_ if unit not in h]
    # units as frequent as the covering ones belong to them, covered or not; rare ones are chance
    usual = np.median([seen[u] for u in chosen]) if chosen else 0
    return {u for u in seen if 6 * seen[u] >= usual} if chosen else set()


def _marked(lexicon: set[str]):
    """Each text's tokens and which of them are labelled toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_tokens(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            marks = [[int(toxic == 1 and not lexicon.isdisjoint(units(w))) for w in own] for own, toxic in zip(words, batch.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"words": pa.array(words, pa.list_(pa.string())), "marks": pa.array(marks, pa.list_(pa.int32()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Chain:
    """A chain from labelled documents; with one label or no telling word it answers that label's share.

    Labels without a doc_id or a value teach nothing; a document labelled twice
    counts as toxic if one label says so; null and empty texts are documents
    without words; further columns of either table are not looked at.
    """
    sample = labelled_sample(docs, labels, fit_docs)
    lexicon = toxic_units(sample)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    prior = (total["t"] + 0.5) / (total["n"] + 1)
    shift = float(np.log(prior / (1 - prior)))
    if not lexicon:
        return Chain([{}, {}, {}, {}], -10.0, np.zeros((2, 2)), (0.0, 0.0, shift))
    marked = sample.mapInArrow(_marked(lexicon), "words array<string>, marks array<int>").toArrow()
    texts = sorted(zip(marked["words"].to_pylist(), marked["marks"].to_pylist(), strict=True))
    weights, bias, moves = fit_chain(texts)
    chain = Chain(weights, bias, moves, (0.0,) * 3)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [summary(p).tolist() for p in chain.marginals(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    seen = sample.mapInArrow(summaries, "x array<double>, toxic int").orderBy("toxic", "x").collect()
    rows, y = np.array([r["x"] for r in seen]), np.array([float(r["toxic"]) for r in seen])
    w = list(_calibrate(rows, y))
    w[2] += shift - float(np.log((sizes[1] + 0.5) / (sizes[0] + 0.5)))
    return Chain(weights, bias, moves, tuple(w))


SPANS = "array<struct<start:int,end:int,p:double>>"


def tag(docs: DataFrame, chain: Chain, keep: list[str], score: str = "score", spans: str | None = "spans") -> DataFrame:
    """The columns ``keep`` of each row, its toxicity score and the offending spans.

    Spans are (start, end, marginal) in code points of words whose marginal is
    above 0.5; ``spans=None`` leaves them out.  Null and empty texts have no
    spans and the score of a text without toxic words; equal texts get equal
    scores; a very long text is scored as a whole; an empty table gives an empty
    result.  Of ``keep``, columns named like the results give way to them.
    """
    keep = [c for c in keep if c.lower() not in {score.lower(), (spans or score).lower()}]
    fields = [*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType())]
    if spans:
        fields.append(T.StructField(spans, T._parse_datatype_string(SPANS)))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            scores, found = [], []
            for some in _groups(texts):
                p = model.marginals([(t or b"").split() for t in some])
                scores += map(model.score, p)
                if spans:
                    found += [_spans(t, x) for t, x in zip(some, p, strict=True)]
            arrays = [*(batch.column(c) for c in keep), pa.array(scores, pa.float64())]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])
        model.known = None  # workers are used again by later stages

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), T.StructType(fields))


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """The texts in runs of about ``_SLICE_BYTES``, at least one text each."""
    own, held = [], 0
    for text in texts:
        own.append(text)
        held += len(text or b"")
        if held >= _SLICE_BYTES:
            yield own
            own, held = [], 0
    if own:
        yield own


def _spans(text: bytes | None, p: np.ndarray) -> list[dict]:
    if not len(p) or p.max() <= 0.5:
        return []
    return [{"start": m.start(), "end": m.end(), "p": float(v)} for m, v in zip(_WORD.finditer(text.decode("utf-8", "replace")), p, strict=True) if v > 0.5]
