"""Per-document text statistics, and what is prose, list, table or junk in a text."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldlead.llm.segments import FREQUENT, NAMES, Lexicon, statistics, word_counts
from fieldlead.llm.shipping import ship_package
from fieldlead.session import checkpointed

KINDS = ("prose", "list", "table", "junk")
COMPONENTS = 96
#: Rounds over all segments after which a fit that still moves is reported.
ROUNDS = 100
#: Log-likelihood per segment must rise by this much for another round.
MIN_GAIN = 5e-4
#: Segments (about; those with the smallest hashes) that the driver sees to choose starting points, and how many of them the k-means
#: before it. The fit itself uses every segment.
START_SEGMENTS = 100_000
START_TRIES = 5
START_CENTRES = 10_000
START_ROUNDS = 500
START_GAIN = 2e-5
#: Documents that are inspected to name the components.
MAX_LABELLED = 20_000
#: Common words are looked up in sets of at most this many.
WORD_BLOCK = 20_000
_VARIANCE_FLOOR = 0.02
_FARTHEST = 8.0
_SEEN = 0.5
_ROWS = 20_000
_CHUNK_CHARS = 300_000  # what a pass over the characters holds at once; it fits the cache


def document_statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Statistics of every document, without Python: one row per document row.

    Columns: doc_id, n_chars_text, n_words, mean_word_length, symbol_ratio (characters that are neither
    letters, digits nor blanks, of all characters), n_lines (lines that are not blank),
    punctuated_line_share (lines that end in . ! ? : or ;), common_word_share (words in the
    common-word table, in any of its languages, of all words). Words are runs of letters and digits. A
    null or blank text has zero words and lines and null ratios.
    """
    listed = _listed(common)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) > 0)
    base = docs.select(
        "doc_id",
        F.length(text).alias("n_chars_text"),
        found.alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")).alias("symbols"),
    )
    words = F.size("w")
    ratio = lambda a, b: F.when(b > 0, a / b)
    blocks = [listed[at : at + WORD_BLOCK] for at in range(0, len(listed), WORD_BLOCK)]
    known = sum((F.size(F.filter("w", _among(b))) for b in blocks), F.lit(0))
    return base.select(
        "doc_id",
        F.col("n_chars_text").cast("bigint").alias("n_chars_text"),
        words.cast("bigint").alias("n_words"),
        ratio(F.length(F.array_join("w", "")), words).alias("mean_word_length"),
        ratio(F.col("symbols"), F.col("n_chars_text")).alias("symbol_ratio"),
        F.size("l").cast("bigint").alias("n_lines"),
        ratio(F.size(F.filter("l", lambda x: F.btrim(x, F.lit(" \t\r")).rlike("[.!?:;]$"))), F.size("l")).alias("punctuated_line_share"),
        ratio(known, words).alias("common_word_share"),
    )


def _listed(common: DataFrame) -> list[str]:
    """The distinct common words in lower case; a word list of languages, not a table that grows with the corpus."""
    return sorted(r[0] for r in common.select(F.lower("word")).where("word is not null").distinct().collect())


def _among(words: list[str]):
    return lambda x: x.isin(words)


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of a bounded number of characters, or one text."""
    sizes = np.cumsum(pdf["text"].str.len().to_numpy())
    for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(sizes // _CHUNK_CHARS)) + 1):
        if len(part):
            yield pdf.iloc[part]


def frequent_words(docs: DataFrame) -> list[tuple[int, int, int]]:
    """(hash, places, places in segments with a sentence end) of the words that make up ``FREQUENT`` of all words of all texts, at most 1 / ``FREQUENT`` of them."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [word_counts(own["text"].tolist()) for own in _chunks(pdf)]
            if parts:
                h, n, inside = (np.concatenate(x) for x in zip(*parts))
                found, at = np.unique(h, return_inverse=True)
                yield pd.DataFrame({"h": found.view(np.int64), "n": np.bincount(at, n, len(found)).astype(np.int64), "inside": np.bincount(at, inside, len(found)).astype(np.int64)})

    counts = docs.where("text is not null").select("text").mapInPandas(run, "h bigint, n bigint, inside bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    counts = checkpointed(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [tuple(r) for r in counts.where(F.col("n") >= F.lit(FREQUENT * total)).collect()]


def segment_statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, chars, x) of every text, written once to the shared folder.

    ``chars`` and ``x`` hold the characters and the statistics of the text's segments as 32-bit floats, one
    row of numbers per segment. Null and blank texts have no segments and no row. Documents that share
    a doc_id count as one document. Two of the statistics tell how much the words of a segment, and of its
    neighbours, are words of running sentences, learned from all texts (``frequent_words``); no word list but the common words
    is written down anywhere.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon.of(_listed(common), frequent_words(docs)))  # numbers, eight or sixteen bytes a word

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in _chunks(pdf):
                who, chars, x = statistics(own["text"].tolist(), shared.value)
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
                if len(first):
                    bounds = [*first, len(who)]
                    x, chars = x.astype(np.float32), chars.astype(np.float32)
                    blobs = [(x[a:b].tobytes(), chars[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                    yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy()[who[first]], "chars": [c for _, c in blobs], "x": [b for b, _ in blobs]})

    return checkpointed(docs.where("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chars binary, x binary"))


@dataclass
class Mixture:
    """A Gaussian mixture with diagonal covariances over standardized statistics."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    rounds: int = 0
    converged: bool = False

    def standardized(self, x: np.ndarray) -> np.ndarray:
        """In 32-bit floats; values far out are drawn in, which bounds the rounding error of the densities."""
        return np.clip((x - self.centre.astype(np.float32)) / self.scale.astype(np.float32), -_FARTHEST, _FARTHEST)

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log-likelihood) of standardized rows."""
        inverse = 1.0 / self.variance
        constant = np.log(self.weight) - 0.5 * ((self.mean**2 * inverse).sum(1) + np.log(self.variance).sum(1))
        # one product of (z squared, z) with both coefficient tables
        lp = np.hstack([z * z, z]) @ np.vstack([-0.5 * inverse.T, (self.mean * inverse).T]).astype(np.float32)
        lp += constant.astype(np.float32)
        top = lp.max(1, keepdims=True)
        lp -= top
        np.exp(lp, out=lp)
        total = lp.sum(1, keepdims=True)
        lp /= total
        return lp, top[:, 0] + np.log(total[:, 0])


def _matrix(x: Iterable[bytes]) -> np.ndarray:
    """Rows of statistics from their stored form."""
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, len(NAMES))


def _summed(parts: DataFrame) -> np.ndarray:
    """Sums per slot over all partitions; only the summed slots reach the driver."""
    rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["slot"]] = r["value"]
    return out


def _sums(table: DataFrame, function, width: int) -> np.ndarray:
    """The sum of ``function(x)`` (a vector of ``width`` numbers per batch) over the whole table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            x = _matrix(pdf["x"])
            for at in range(0, len(x), _ROWS):
                total += function(x[at : at + _ROWS])
        yield pd.DataFrame({"slot": np.arange(width), "value": total})

    got = _summed(table.select("x").mapInPandas(run, "slot int, value double"))
    return got if len(got) else np.zeros(width)


def _starts(z: np.ndarray, components: int, tries: int = START_TRIES) -> np.ndarray:
    """Starting points: k-means centres of standardized segments, spread by distance, the tightest of some tries; the same on every run, without any label."""
    square = (z * z).sum(1)
    best, tightest = None, np.inf
    for seed in range(tries):
        random = np.random.default_rng(seed)
        centres = z[random.integers(len(z))][None]
        far = ((z - centres[0]) ** 2).sum(1)
        while len(centres) < components:
            point = z[random.choice(len(z), p=far / far.sum())] if far.sum() > 0 else z[random.integers(len(z))]
            centres = np.vstack([centres, point])
            far = np.minimum(far, ((z - point) ** 2).sum(1))
        for _ in range(10):
            apart = (centres * centres).sum(1) - 2 * z @ centres.T
            near = apart.argmin(1)
            centres = np.array([z[near == k].mean(0) if (near == k).any() else centres[k] for k in range(components)])
        spread = (square + apart.min(1)).sum()
        if spread < tightest:
            best, tightest = centres, spread
    return best


def _step(model: Mixture, x: np.ndarray) -> np.ndarray:
    """What a round needs from some segments: log-likelihood, responsibilities, responsibility-weighted values and squares, summed."""
    z = model.standardized(x)
    r, likelihood = model.responsibilities(z)
    return np.r_[likelihood.sum(dtype=float), r.sum(0, dtype=float), (r.T @ z).ravel(), (r.T @ (z * z)).ravel()]


def _improved(model: Mixture, sums: np.ndarray) -> Mixture:
    """The maximization step. Variances have a floor, which they may lie at but not below: so the likelihood never falls."""
    k, d = model.mean.shape
    mass = sums[1 : 1 + k] + 1e-9
    mean = sums[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
    square = sums[1 + k + k * d :].reshape(k, d) / mass[:, None]
    return Mixture(model.centre, model.scale, np.maximum(mass / mass.sum(), 1e-12), mean, np.maximum(square - mean**2, _VARIANCE_FLOOR), model.rounds + 1)


def _maximize(model: Mixture, summed, n: float, rounds: int, min_gain: float) -> Mixture:
    """EM rounds until the log-likelihood per segment rises by less than ``min_gain``; ``summed(step, width)`` adds a step over the segments."""
    k, d = model.mean.shape
    before, model.rounds = -np.inf, 0
    for _ in range(rounds):
        sums = summed(functools.partial(_step, model), 1 + k + 2 * k * d)
        model = _improved(model, sums)
        if sums[0] / n - before < min_gain:
            model.converged = True
            break
        before = sums[0] / n
    return model


def _sampled(table: DataFrame, share: float) -> np.ndarray:
    """Segments with the smallest hashes of document and place, about ``share`` of all, in the order of the hashes."""
    limit = np.uint64(min(1.0, share) * (2.0**64 - 2048))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 4 * len(NAMES)
        for pdf in batches:
            counts = (pdf["x"].str.len() // size).to_numpy(np.int64)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            h = np.repeat(pdf["h"].to_numpy(np.int64).view(np.uint64), counts) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            picked = h <= limit
            x = _matrix(pdf["x"])[picked]
            yield pd.DataFrame({"h": h[picked].view(np.int64), "x": [v.tobytes() for v in x]})

    rows = table.select(F.xxhash64("doc_id").alias("h"), "x").mapInPandas(run, "h bigint, x binary").collect()
    return _matrix(r["x"] for r in sorted(rows))


def fit_mixture(table: DataFrame, components: int = COMPONENTS, rounds: int = ROUNDS, min_gain: float = MIN_GAIN, start_segments: int = START_SEGMENTS) -> Mixture:
    """Expectation-maximization over every segment of ``table``.

    A round is one pass: each task sums responsibilities, responsibility-weighted values and squares over
    its segments, the sums meet in a shuffle of a few thousand numbers per task, and the driver sees only
    the totals. Equal segments weigh as often as they occur.

    Rounds are costly, so the first ones are run on about ``start_segments`` segments on the driver, from
    k-means centres; they only choose where the rounds over everything start. Those go on until the
    likelihood of all segments has settled; a fit that has not settled after ``rounds`` is returned with
    ``converged`` false, and a warning says so.
    """
    d = len(NAMES)
    ship_package(table.sparkSession)
    sums = _sums(table, lambda x: np.r_[len(x), x.sum(0, dtype=float), (x.astype(float) ** 2).sum(0)], 1 + 2 * d)
    n = max(sums[0], 1.0)
    centre = sums[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d :] / n - centre**2, 0.0)) + 1e-6
    model = Mixture(centre, scale, np.full(components, 1 / components), np.zeros((components, d)), np.ones((components, d)))
    some = _sampled(table, start_segments / n)
    model.mean = _starts(model.standardized(some[:START_CENTRES]).astype(float), components)
    model = _maximize(model, lambda step, width: sum(step(some[at : at + _ROWS]) for at in range(0, len(some), _ROWS)), len(some), START_ROUNDS, START_GAIN)
    model = _maximize(model, lambda step, width: _sums(table, step, width), n, rounds, min_gain)
    if not model.converged:
        warnings.warn(f"the mixture still moves after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return model


def name_components(shares: np.ndarray, kind: np.ndarray, kinds: int, mean: np.ndarray | None = None) -> np.ndarray:
    """Which kind each component is (a row of one 1 per component), from inspected documents.

    ``shares`` holds the share of each component in the characters of an inspected document. A component
    first gets the kind whose documents hold the largest share of it on average, so that a frequent kind
    does not take every component. As documents mix kinds, names are then exchanged one at a time, the
    component with most characters first, as long as the inspected documents come out nearer to what their
    readers saw (squared distance of the shares of the kinds). A component of which the inspected documents
    hold less than half a document is named like the nearest other one by ``mean`` (without it: the last kind).
    """
    found = np.array([shares[kind == k].mean(0) if (kind == k).any() else np.zeros(shares.shape[1]) for k in range(kinds)])
    name, seen = found.argmax(0), np.flatnonzero(shares.sum(0) >= _SEEN)
    off = shares @ np.eye(kinds)[name] - np.eye(kinds)[kind]
    changed = True
    while changed:
        changed = False
        for j in np.argsort(-shares.sum(0), kind="stable"):
            own = shares[:, j]
            # what the squared distance loses and gains by moving the component's characters to another kind
            gain = [0.0 if k == name[j] else (own * (own + off[:, k] - off[:, name[j]])).sum() for k in range(kinds)]
            best = int(np.argmin(gain))
            if gain[best] < -1e-9:
                off[:, name[j]] -= own
                off[:, best] += own
                name[j] = best
                changed = True
    for j in np.flatnonzero(shares.sum(0) < _SEEN):
        name[j] = name[seen[((mean[seen] - mean[j]) ** 2).sum(1).argmin()]] if mean is not None and len(seen) else kinds - 1
    return np.eye(kinds)[name]


def _document_sums(table: DataFrame, model: Mixture, weights: np.ndarray) -> DataFrame:
    """Per doc_id: characters and, for each column of ``weights``, the characters that fall to it."""
    width = weights.shape[1]
    kind = dict(table.dtypes)["doc_id"]
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, chars = _matrix(pdf["x"]), np.frombuffer(b"".join(pdf["chars"]), np.float32).astype(float)
            parts = [model.responsibilities(model.standardized(x[at : at + _ROWS]))[0] @ weights for at in range(0, len(x), _ROWS)]
            start = np.cumsum([0, *(len(c) // 4 for c in pdf["chars"].iloc[:-1])])
            out = pd.DataFrame(np.add.reduceat(np.concatenate(parts) * chars[:, None], start), columns=names)
            out.insert(0, "chars", np.add.reduceat(chars, start))
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {kind}, chars double, " + ", ".join(f"{n} double" for n in names)
    parts = table.select("doc_id", "chars", "x").mapInPandas(run, schema)
    return parts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("chars", *names)])


def labelled_documents(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled documents (those with the smallest hash), one label each: the most frequent, then the first by name."""
    clean = labels.select("doc_id", F.lower(F.btrim("label")).alias("label")).where(F.col("label").isin(*KINDS) & F.col("doc_id").isNotNull())
    votes = clean.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    one = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "label")).alias("v")).select("doc_id", F.col("v.label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def document_kinds(docs: DataFrame, labels: DataFrame, common: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(doc_id, chars, prose_share, list_share, table_share, junk_share, kind) of every text that is not null or blank.

    A Gaussian mixture is fitted by EM to the standardized statistics of all segments, without labels;
    inspected documents then name its components (``name_components``), and the shares are the characters
    of a document that fall to components of a kind. ``kind`` is prose from half of the characters on,
    else the largest of the others. Without inspected prose or without any other kind no component can be
    named, and the result is empty.
    """
    table = segment_statistics(docs, common)
    chosen = checkpointed(labelled_documents(labels))
    shares = [f"{k}_share" for k in KINDS]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, chars double, " + ", ".join(f"{s} double" for s in shares) + ", kind string"
    known = checkpointed(table.join(F.broadcast(chosen), "doc_id"))  # at most MAX_LABELLED rows of ``chosen``
    labelled_kinds = {r[0] for r in known.select("label").distinct().collect()}
    if "prose" not in labelled_kinds or len(labelled_kinds) < 2:
        return docs.sparkSession.createDataFrame([], schema)
    model = fit_mixture(table, components)
    k = len(model.weight)
    inspected = _document_sums(known.drop("label"), model, np.eye(k)).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    x = np.array([[r[f"s{i}"] for i in range(k)] for r in inspected]) / np.array([[max(r["chars"], 1.0)] for r in inspected])
    weights = name_components(x, np.array([KINDS.index(r["label"]) for r in inspected]), len(KINDS), model.mean)
    sums = _document_sums(table, model, weights)
    split = sums.select("doc_id", "chars", *[(F.col(f"s{i}") / F.col("chars")).alias(s) for i, s in enumerate(shares)])
    others = F.greatest(*[F.struct(F.col(s).alias("s"), F.lit(k).alias("k")) for s, k in zip(shares[1:], KINDS[1:])])
    return split.withColumn("kind", F.when(F.col("prose_share") >= 0.5, "prose").otherwise(others["k"]))
