"""Subject areas of documents.

1. Hand-labelled documents (at most ``FIT_DOCS``, a parameter) give the vocabulary, and how far a word's labels are from the
   usual mix; the ``DIMS`` words that tell most span the vectors.
2. Every document is read whole, once, into the counts of its known words, which are written to the shared folder.
3. The normalised vectors of all documents, words weighted by their rarity in the corpus, are clustered by bisecting
   k-means: each task brings its documents to a few weighted centroids, these are brought together again until ``MICRO`` are
   left, and the tree is grown over those. Every document counts, and what reaches the driver doesn't grow with them.
4. A leaf is named by its discriminative terms, those that it has more of than the corpus; labels only say what subject a
   term speaks for.
5. Leaves become components of a mixture (with one more for the language common to all), refined by
   expectation-maximisation on the labelled documents, in which a document may only use leaves of its own labels' subjects or
   of its own leaf's, so a few wrong labels do no harm.
6. A document's words are shared out to the leaves, leaves added up by subject, and each subject with a substantial share of
   the words that speak of any subject is assigned.

Defined cases: null, empty and blank texts, and texts without a word that speaks of a subject, have no
row; labels of unknown documents are left out; without any label there is no row; repeated documents
get equal subjects; a document may have at most ``1 / SHARE`` subjects.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.session import materialize

#: Labelled documents that the model is fitted to, at most; leaves of the cluster tree, at most; words that it knows, at most
#: (the most frequent in the labelled documents), and of these the ones that span the vectors.
FIT_DOCS, LEAVES, WORDS, DIMS = 8_000, 64, 12_000, 1_024
#: Times that a word counts in one labelled document, at most, so that none is fitted to a few long ones.
REPEATS = 8
#: Documents that one task clusters at once, the centroids that it makes of them, and those that the tree is grown over.
TOGETHER, PARTS, MICRO = 4_096, 32, 256
#: Discriminative terms of a leaf that name it.
TERMS = 12
#: Share of the subject words that a subject needs; probability from which a word speaks of subjects at all; such words needed in a text, and in a short one.
SHARE, SPEAKS, LEAST, LEAST_SHORT, SHORT = 0.22, 0.6, 2, 1, 30

#: Words: parts of camelCase and snake_case names, any alphabet; runs of scripts without blanks become pairs of characters.
_WORD = re.compile(r"[A-Z]?[a-zß-öø-ÿœ]+|[A-ZÀ-ÖØ-Þ]+(?![a-z])|[぀-ヿ㐀-鿿]+|[^\W\d_A-Za-zÀ-ÿœ぀-ヿ㐀-鿿]+")
_PAIRS = re.compile(r"[぀-ヿ㐀-鿿]")
#: Lines that name no matter: headers of a commit, merge lines, binary content and its paths.
_NEUTRAL = re.compile(
    r"^(?:commit [0-9a-f]{7,}|Author: |AuthorDate: |Commit: |Committer: |Date: |From: |From [0-9a-f]{20,}|Merge: |r\d+ \| |index [0-9a-f]+\.\.|Binary files |literal \d|delta \d|GIT binary patch"
    r"|similarity index |[-+]{3} \S+\.(?:png|jpe?g|gif|ico|pdf|zip|gz|bin|woff2?|jar|mp[34]|exe|so|dll|class|ttf)\b|diff --git \S+\.(?:png|jpe?g|gif|ico|pdf|zip|gz|bin|woff2?|jar|mp[34]|exe|so|dll|class|ttf)\b"
    r"|[ *]*(?:Subject: (?:\[PATCH[^\]]*\] )?)?(?:[0-9a-f]{7,} )?(?:Merged? (?:branch|remote-tracking|pull request|in |tag |commit |\S+ \([0-9a-f]+\) into|\S+ into)|Automatic merge)|\s*(?:Signed-off-by|Co-authored-by|Reviewed-by|Acked-by|Change-Id|Cc): ).*$",
    re.M,
)


def words(text: str) -> list[str]:
    """The words of a whole text, in order."""
    out = []
    for w in _WORD.findall(_NEUTRAL.sub("", text)):
        if _PAIRS.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w.lower())
    return out


def bisecting_kmeans(x: np.ndarray, leaves: int, least: float, seed: int = 5, rounds: int = 8, tries: int = 3, weight: np.ndarray | None = None) -> np.ndarray:
    """Leaf number of each row of ``x`` (sums of ``weight`` unit vectors, by default one): the leaf with the largest spread is split in two, again and again."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(len(x), np.int64)
    weight = np.ones(len(x)) if weight is None else weight
    spread = lambda rows: weight[rows].sum() - np.linalg.norm(x[rows].sum(axis=0)) if len(rows) else 0.0
    open_leaves = {0: spread(np.arange(len(x)))}
    count = 1
    while count < leaves and open_leaves:
        k = max(open_leaves, key=open_leaves.get)
        rows = np.flatnonzero(leaf == k)
        del open_leaves[k]
        if weight[rows].sum() < 2 * least or len(rows) < 2:
            continue
        xs = x[rows]
        best = None
        for _ in range(tries):
            a = xs[rng.integers(len(rows))]
            a = xs[np.argmin(xs @ a)]
            b = xs[np.argmin(xs @ a)]
            for _ in range(rounds):
                right = xs @ b > xs @ a
                if not right.any() or right.all():
                    break
                a, b = (v / max(np.linalg.norm(v), 1e-12) for v in (xs[~right].sum(axis=0), xs[right].sum(axis=0)))
            gain = float(np.maximum(xs @ a, xs @ b).sum())
            if right.any() and not right.all() and (best is None or gain > best[0]):
                best = (gain, right)
        if best is None or min(weight[rows][best[1]].sum(), weight[rows][~best[1]].sum()) < least:
            continue
        leaf[rows[best[1]]] = count
        open_leaves[k], open_leaves[count] = spread(np.flatnonzero(leaf == k)), spread(np.flatnonzero(leaf == count))
        count += 1
    return leaf


@dataclass
class Model:
    """subjects; per known word its share in each subject; of each leaf the subject and the terms that named it."""

    subjects: list[str]
    known: np.ndarray  # numbers of the words that speak of subjects
    shares: np.ndarray
    leaf_subjects: list[str]
    leaf_terms: list[list[str]]

    def assign(self, doc: np.ndarray, word: np.ndarray, times: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Documents by subjects: whether it is one of theirs. Entry i says that known word ``word[i]`` is ``times[i]`` times in document ``doc[i]``; ``n_words`` are the documents' lengths."""
        size = max(int(word.max(initial=-1)), int(self.known.max(initial=-1))) + 1
        place = np.full(size, -1)
        place[self.known] = np.arange(len(self.known))
        at = place[word]
        doc, times, at = doc[at >= 0], times[at >= 0], at[at >= 0]
        hits = np.bincount(doc, times, len(n_words))
        mass = np.zeros((len(n_words), len(self.subjects)))
        for c in range(len(self.subjects)):
            mass[:, c] = np.bincount(doc, times * self.shares[at, c], len(n_words))
        enough = hits >= np.where(n_words <= SHORT, LEAST_SHORT, LEAST)
        # a single stray word makes no further subject, unless it is as much as the rest
        large = (mass >= SHARE * mass.sum(axis=1, keepdims=True)) & ((mass >= 1.5) | (mass >= 0.8 * mass.max(axis=1, keepdims=True)))
        return large & enough[:, None] & (hits > 0)[:, None]


@dataclass
class Sample:
    """Documents' words in flat arrays: entry i says that ``words[word[i]]`` occurs ``times[i]`` times in document ``doc[i]``."""

    words: list[str]
    doc: np.ndarray
    word: np.ndarray
    times: np.ndarray
    labels: list[list[str]]

    @staticmethod
    def of(documents: list[tuple[str, list[str]]]) -> Sample:
        """Of texts with their labels."""
        counted = [(Counter(words(t)), y) for t, y in documents]
        names = sorted({w for c, _ in counted for w in c})
        at = {w: i for i, w in enumerate(names)}
        flat = [(d, at[w], n) for d, (c, _) in enumerate(counted) for w, n in c.items()]
        doc, word, times = (np.array(v, np.int64) for v in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
        return Sample(names, doc, word, times, [y for _, y in counted])


@dataclass
class Vocabulary:
    """Known words with what the labelled documents say of them."""

    words: list[str]
    place: np.ndarray  # per word of the sample its number here, or -1
    labels: np.ndarray  # documents of the sample by subjects
    documents: np.ndarray  # labelled documents that hold a word
    speaks: np.ndarray  # words by subjects: share of the labels where it stands
    tells: np.ndarray  # how far these are from the usual mix
    dims: np.ndarray  # numbers of the words that span the vectors

    @staticmethod
    def of(sample: Sample, subjects: list[str], most_words: int = WORDS, dims: int = DIMS) -> Vocabulary | None:
        """None where nothing is labelled."""
        at = {s: i for i, s in enumerate(subjects)}
        labels = np.zeros((len(sample.labels), len(subjects)))
        for d, ys in enumerate(sample.labels):
            own = [at[y] for y in set(ys) if y in at]
            labels[d, own] = 1 / max(len(own), 1)
        counted = np.bincount(sample.word, minlength=len(sample.words))
        enough = 2 if len(labels) >= 200 else 1
        fair = np.array([n >= enough and (len(w) > 2 or not w.isascii()) for w, n in zip(sample.words, counted)], bool)
        taken = np.flatnonzero(fair)
        taken = taken[np.argsort(-counted[taken], kind="stable")][:most_words]
        if not len(taken) or not labels.any():
            return None
        place = np.full(len(sample.words), -1)
        place[taken] = np.arange(len(taken))
        inside = (place[sample.word] >= 0) & labels.any(axis=1)[sample.doc]
        doc, word = sample.doc[inside], place[sample.word[inside]]
        usual = labels.mean(axis=0) + 1e-9
        mix = np.zeros((len(taken), len(subjects)))
        for c in range(len(subjects)):
            mix[:, c] = np.bincount(word, labels[doc, c], len(taken))
        n_w = mix.sum(axis=1, keepdims=True)
        p = (mix + 2 * usual) / (n_w + 2)
        tells = (p * np.log(p / usual)).sum(axis=1)
        order = np.argsort(-tells * np.log1p(n_w[:, 0]), kind="stable")
        chosen = order[p.max(axis=1)[order] >= 0.5][:dims]
        return Vocabulary([sample.words[i] for i in taken], place, labels, counted[taken], p, tells, chosen if len(chosen) else order[:dims])


def vectors(doc: np.ndarray, word: np.ndarray, times: np.ndarray, docs: int, dims: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vectors of documents over ``dims``, words weighted."""
    place = np.full(max(int(word.max(initial=-1)), int(dims.max(initial=-1))) + 1, -1)
    place[dims] = np.arange(len(dims))
    use = place[word] >= 0
    x = np.zeros((docs, len(dims)), np.float32)
    np.add.at(x, (doc[use], place[word[use]]), np.sqrt(times[use]) * weight[place[word[use]]])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Leaves:
    """Clusters of the corpus: unit centroids, and how much of its documents' weight a word has in each."""

    centroids: np.ndarray
    mass: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> Leaves:
        """Of weighted centroids (sums of unit vectors)."""
        leaf = bisecting_kmeans(sums, leaves, max(3.0, weight.sum() / 400), weight=weight)
        mass = np.zeros((int(leaf.max(initial=0)) + 1, sums.shape[1]))
        np.add.at(mass, leaf, sums)
        return Leaves(mass / np.maximum(np.linalg.norm(mass, axis=1, keepdims=True), 1e-9), mass)

    def terms(self, most: int = TERMS) -> list[list[tuple[int, float]]]:
        """Of each leaf the words (places in the vectors) that it has more of than the corpus, with how much they say for it."""
        share = self.mass / np.maximum(self.mass.sum(axis=1, keepdims=True), 1e-9)
        usual = self.mass.sum(axis=0) / max(self.mass.sum(), 1e-9)
        says = share * np.log(np.maximum(share, 1e-12) / np.maximum(usual, 1e-12))
        return [[(int(i), float(row[i])) for i in np.argsort(-row, kind="stable")[:most] if row[i] > 0] for row in says]


def fit(sample: Sample, subjects: list[str], v: Vocabulary, leaves: Leaves, weight: np.ndarray, rounds: int = 12) -> Model:
    """The mixture, from the labelled documents and the leaves of the corpus; ``weight`` is that of the words of the vectors."""
    inside = (v.place[sample.word] >= 0) & v.labels.any(axis=1)[sample.doc]
    doc, word, times = sample.doc[inside], v.place[sample.word[inside]], np.minimum(sample.times[inside], REPEATS).astype(np.float32)
    n_docs, labels = len(v.labels), v.labels
    # the leaf's terms name it; it is sure where they agree, and so do its labelled documents
    by_terms = np.zeros((len(leaves.centroids), len(subjects)))
    listed = leaves.terms()
    for c, terms in enumerate(listed):
        for i, says in terms:
            by_terms[c] += says * v.speaks[v.dims[i]]
    named = by_terms.argmax(axis=1)
    leaf = (vectors(doc, word, times, n_docs, v.dims, weight) @ leaves.centroids.T.astype(np.float32)).argmax(axis=1)
    by_leaf = np.zeros_like(by_terms)
    np.add.at(by_leaf, leaf, labels)
    sure = by_leaf[np.arange(len(named)), named] >= 0.8 * np.maximum(by_leaf.sum(axis=1), 1e-9)
    k, leaf_terms = len(named), [[v.words[v.dims[i]] for i, _ in terms] for terms in listed]
    # a subject that names no leaf has one of its own, without documents
    for s in range(len(subjects)):
        if labels[:, s].any() and s not in named:
            named, sure, k, leaf_terms = np.append(named, s), np.append(sure, False), k + 1, [*leaf_terms, []]
    allowed = labels[:, named] > 0
    allowed |= (named[None, :] == named[leaf][:, None]) & sure[leaf][:, None]
    allowed = np.hstack([allowed, np.ones((n_docs, 1), bool)]).astype(np.float32)
    # start: a document's words belong to its own leaf, to the leaves of its labels, and to the common language
    theta = allowed * 0.2
    own = allowed[np.arange(n_docs), leaf] > 0
    theta[np.flatnonzero(own), leaf[own]] += 1
    theta[:, -1] = 1
    theta /= theta.sum(axis=1, keepdims=True)
    w = np.full((len(v.words), k + 1), 0.01, np.float32)
    for a in range(0, len(doc), 50_000):
        part = slice(a, a + 50_000)
        np.add.at(w, word[part], times[part, None] * theta[doc[part]])
    w /= w.sum(axis=0)
    for _ in range(rounds):
        new_w, new_t = np.full_like(w, 0.005), np.full_like(theta, 0.01)
        for a in range(0, len(doc), 50_000):
            d, j, n = doc[a : a + 50_000], word[a : a + 50_000], times[a : a + 50_000]
            part = w[j] * theta[d]
            part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            np.add.at(new_w, j, part)
            np.add.at(new_t, d, part)
        w, theta = new_w / new_w.sum(axis=0), new_t * allowed
        theta /= theta.sum(axis=1, keepdims=True)
    per = np.zeros((len(v.words), len(subjects)))
    for c in range(k):
        per[:, named[c]] += new_w[:, c]
    every = new_w.sum(axis=1)
    # a word seen in few documents is trusted less
    trust = v.documents / (v.documents + 1)
    speaks, top = trust * per.sum(axis=1) / every, trust * per.max(axis=1) / every
    keep = np.flatnonzero((speaks >= SPEAKS) & (top >= SPEAKS))
    return Model(subjects, keep, per[keep] / per[keep].sum(axis=1, keepdims=True), [subjects[s] for s in named], leaf_terms)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counted = [Counter(words(t)) if t else Counter() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("k"), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())), b.column("labels")],
            names=["k", "words", "times", "labels"],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, subject: str, most: int = FIT_DOCS) -> Sample:
    """Words, their counts and labels of at most ``most`` labelled documents, chosen at random but always alike."""
    named = labels.where(F.col(subject).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_set(subject)).alias("labels"))
    few = named.orderBy(F.xxhash64("_k"), "_k").limit(most)
    # bounded by ``most`` ids and their labels
    joined = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(few), F.col(key) == F.col("_k")).select(F.col("_k").cast("string").alias("k"), "text", "labels")
    got = joined.mapInArrow(_count_batches, "k string, words array<string>, times array<int>, labels array<string>").toArrow().sort_by("k").combine_chunks()
    listed = got.column("words").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    names = coded.dictionary.to_pylist()
    # the order of the words shall not depend on that of the rows
    order = np.argsort(np.array(names, object), kind="stable") if names else np.zeros(0, np.int64)
    rank = np.zeros(len(names), np.int64)
    rank[order] = np.arange(len(names))
    times = got.column("times").combine_chunks().flatten().to_numpy()
    return Sample([names[i] for i in order], doc, rank[coded.indices.to_numpy()], times, got.column("labels").to_pylist())


def _known_batches(batches: Iterator[pa.RecordBatch], names: list[str], key: str) -> Iterator[pa.RecordBatch]:
    get = {w: i for i, w in enumerate(names)}.get
    for b in batches:
        held, times, length = [], [], []
        for t in b.column("text").to_pylist():
            all_words = words(t) if t else []
            c = Counter(i for i in map(get, all_words) if i is not None)
            held.append(list(c))
            times.append(list(c.values()))
            length.append(len(all_words))
        ids = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(key), pa.array(held, ids), pa.array(times, ids), pa.array(length, pa.int32())], names=[key, "word", "times", "length"])


def _flat(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc (number of the row), word, times."""
    word = b.column("word")
    doc = np.repeat(np.arange(len(word)), np.diff(word.offsets.to_numpy()))
    return doc, word.flatten().to_numpy(), b.column("times").flatten().to_numpy()


SUMS = "sums array<float>, weight double"


def _gathered(sums: np.ndarray, weight: np.ndarray, parts: int) -> pa.RecordBatch:
    """A few centroids that stand for many: sums of those that bisecting k-means puts together."""
    leaf = bisecting_kmeans(sums, parts, 1, rounds=4, tries=1, weight=weight)
    made, n = np.zeros((int(leaf.max()) + 1, sums.shape[1]), np.float32), np.bincount(leaf, weight)
    np.add.at(made, leaf, sums)
    return pa.RecordBatch.from_arrays([pa.array(list(made), pa.list_(pa.float32())), pa.array(n)], names=["sums", "weight"])


def _micro_batches(batches: Iterator[pa.RecordBatch], dims: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        x = np.vstack(held)
        held.clear()
        if len(x):
            yield _gathered(x, np.ones(len(x)), PARTS)

    for b in batches:
        x = vectors(*_flat(b), b.num_rows, dims, weight)
        x = x[x.any(axis=1)]
        held.append(x)
        n += len(x)
        if n >= TOGETHER:
            yield from made()
            n = 0
    if held:
        yield from made()


def _merged_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All that comes to a task, in one go."""
    got = [(np.vstack(b.column("sums").to_numpy(zero_copy_only=False)), b.column("weight").to_numpy()) for b in batches if b.num_rows]
    if got:
        sums, weight = np.vstack([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((sums[:, 0], weight))
        yield _gathered(sums[order], weight[order], parts)


def corpus_leaves(known: DataFrame, dims: np.ndarray, weight: np.ndarray) -> Leaves:
    """Bisecting k-means over all documents (word, times)."""
    micro = materialize(known.select("word", "times").mapInArrow(lambda it: _micro_batches(it, dims, weight), SUMS), "micro")
    while (many := micro.count()) > TOGETHER:
        micro = materialize(micro.repartition(-(-many // TOGETHER)).mapInArrow(lambda it: _merged_batches(it, PARTS), SUMS), "micro")
    got = micro.coalesce(1).mapInArrow(lambda it: _merged_batches(it, MICRO), SUMS).toArrow()
    if not got.num_rows:
        return Leaves(np.zeros((1, len(dims))), np.zeros((1, len(dims))))
    return Leaves.of(np.vstack(got.column("sums").to_numpy()), got.column("weight").to_numpy())


def rarity(known: DataFrame, dims: np.ndarray) -> np.ndarray:
    """Weight of the words of the vectors: the logarithm of all documents over those that hold it."""
    held = known.select(F.explode("word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # one row per known word
    counts, docs = {r["word"]: r["n"] for r in held.collect()}, known.count()
    return np.array([np.log((docs + 1) / (counts.get(int(i), 0) + 1)) for i in dims]).clip(min=1e-3)


def _assign_batches(batches: Iterator[pa.RecordBatch], model: Model, key: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, which = np.nonzero(model.assign(*_flat(b), b.column("length").to_numpy()))
        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), pa.array([model.subjects[i] for i in which], pa.string())], names=[key, "subject"])


def learn(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str, text: str, subject: str, most: int = FIT_DOCS) -> tuple[Model, DataFrame]:
    """The model, and key, word, times, length of every document."""
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, word array<int>, times array<int>, length int"
    sample = labelled_sample(docs, labels, key, text, subject, most)
    v = Vocabulary.of(sample, subjects)
    if v is None:
        return Model(subjects, np.zeros(0, np.int64), np.zeros((0, len(subjects))), [], []), rows.sparkSession.createDataFrame([], schema)
    known = materialize(rows.mapInArrow(lambda it: _known_batches(it, v.words, key), schema), "words")
    weight = rarity(known, v.dims)
    return fit(sample, subjects, v, corpus_leaves(known, v.dims, weight), weight), known


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", subject: str = "subject", most: int = FIT_DOCS) -> DataFrame:
    """key, subject: a row for each subject that a substantial share of the document is about."""
    model, known = learn(docs, labels, subjects, key, text, subject, most)
    return known.mapInArrow(lambda it: _assign_batches(it, model, key), f"`{key}` {known.schema[key].dataType.simpleString()}, subject string")
