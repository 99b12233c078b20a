"""Subject areas of documents (problem 8).

A document has each subject that at least a fourth of its sentences are about, so sentences are what is classified. A
complement naive Bayes model of the labelled documents gives first posteriors for their sentences; expectation-maximization
lets every sentence be about one of its document's labels or about nothing, and is then refined over the sentences of all
documents, labelled or not, each sentence being about nothing or one of the subjects its document has a share of; a
labelled document's sentences count once, with its labels. A sentence is about one thing, so its posteriors compete; a
document's don't: its score for a subject is the mean posterior of its sentences, and a logistic fit, one subject at a time,
turns it into the posterior that the subject is one of the document's. The fit is to the scores that labelled documents
have under a model without themselves, and starts from the share that the question names.

Words are hashed, so the model has a fixed size (``FEATURES`` x subjects) however large the corpus is: that is what is
broadcast, and what a pass over the corpus adds up, first within each task. At most ``MAX_LABELLED`` labelled documents are
read to the driver; all else covers every document.

Cases: a null or blank text has no subject; a sentence may run over several lines; in a text without a single end mark each
line of ``PLAIN_WORDS`` words or more is one; labels are compared trimmed and in lower case, those that are no
subject of the list are ignored, a null one says "none of them"; without any label nothing is found; repeated rows of an
id count once; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 17
MAX_LABELLED = 20_000
LABELLED_ROUNDS = 10
CORPUS_ROUNDS = 2
SMOOTHING = 0.005
PRIOR = 1.0
TEMPER = 0.7  # of the words' evidence, as they don't come independently
SHARE = 0.2  # of a document's sentences that a subject needs to stay possible for the rest of them
#: What calibration starts from: a document has a subject from about this share on, at this slope; and how much the fit may
#: move from there (standard deviations of slope and intercept). Labels are few, and some are wrong.
EXPECTED_CUT, EXPECTED_SLOPE, SPREAD = 0.21, 60.0, (2.0, 0.25)
PLAIN_WORDS = 6
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_LEAD = re.compile(r"^(?:\s*(?:>|//[/!]?|[*+-](?=\s)|#+(?=\s)|\d+\.(?=\s)))+")
_MARK = re.compile(r"\s*(?:[*+-]\s|#+\s|\d+\.\s|\||[=-]{3,})")
_SPLIT = re.compile(r"(?<=[.!?])[\"”»)*_`]*\s+")
_END = re.compile(r"[.!?…][\"”»)*_`]*\s*$")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence: what ends with a full stop, question or exclamation mark outside of code and markup.

    What has no end yet goes on in the next line, unless that begins with a mark of its own or is blank.
    """
    out: list[list[str]] = []
    if "```" in text or "~~~" in text or "<pre" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    rest, plain = "", []
    for raw in text.split("\n"):
        line = _LEAD.sub("", raw).strip()
        if not line:
            rest = ""
            continue
        plain.append(line)
        if rest and not _MARK.match(raw):
            line = f"{rest} {line}"
        rest = ""
        parts = _SPLIT.split(line)
        for n, s in enumerate(parts):
            # every part but the last ends with a mark, though the split may have taken closing quotes from it
            if n < len(parts) - 1 or _END.search(s):
                words = _WORD.findall(s.lower())
                if words:
                    out.append(words)
            elif not raw.lstrip().startswith("#"):
                rest = s
    return out or [w for line in plain if len(w := _WORD.findall(line.lower())) >= PLAIN_WORDS]


class Words:
    """Hashed words of batches of sentences; remembers the hashes of common words."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (unigrams, then the bigrams' ends), bounds of the sentences in them, and the text of each sentence."""
        memo = self.memo
        flat: list[int] = []
        bounds = [0]
        owner: list[int] = []
        for n, text in enumerate(texts):
            if not text:
                continue
            for words in sentences(text):
                for w in words:
                    h = memo.get(w)
                    if h is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        h = memo[w] = zlib.crc32(w.encode("utf-8", "replace"))
                    flat.append(h)
                bounds.append(len(flat))
                owner.append(n)
        return np.array(flat, dtype=np.uint64), np.array(bounds, dtype=np.int64), np.array(owner, dtype=np.int64)


def features(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and sentence of every unigram and bigram."""
    sentence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    one = flat % FEATURES
    two = ((flat[:-1] * np.uint64(0x9E3779B1) + flat[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % FEATURES if len(flat) > 1 else flat[:0]
    inside = sentence[:-1] == sentence[1:] if len(flat) > 1 else np.zeros(0, dtype=bool)
    return np.concatenate([one, two[inside]]).astype(np.int64), np.concatenate([sentence, sentence[:-1][inside]]) if len(flat) > 1 else sentence


def posteriors(feature: np.ndarray, sentence: np.ndarray, count: int, weights: np.ndarray, prior: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    scores = np.empty((count, weights.shape[1]))
    for k in range(weights.shape[1]):
        scores[:, k] = np.bincount(sentence, weights=weights[feature, k], minlength=count)
    scores = scores * TEMPER + prior
    if allowed is not None:
        scores = np.where(allowed, scores, -1e9)
    scores -= scores.max(axis=1, keepdims=True)
    scores = np.exp(scores)
    return scores / scores.sum(axis=1, keepdims=True)


def counts(feature: np.ndarray, sentence: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(feature, weights=shares[sentence, k], minlength=FEATURES) for k in range(shares.shape[1])], axis=1)


def model(table: np.ndarray, mass: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of features and log prior of classes from expected counts.

    A class's distribution is drawn towards the background's as if it had ``PRIOR`` times an average class's words from
    there: words that are just as common elsewhere then tell next to nothing, though chance gave one subject more of them.
    """
    strength = PRIOR * table.sum() / table.shape[1] + 1e-9
    base = background + SMOOTHING
    base = base / base.sum()
    weights = np.log((table + strength * base[:, None]) / (table.sum(axis=0) + strength))
    return weights.astype(np.float32), np.log((mass + 1.0) / (mass.sum() + len(mass)))


def within_document(p: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which classes a sentence may have, given how its document's sentences look: those with a share, and none."""
    size = int(owner[-1]) + 1 if len(owner) else 0
    share = np.stack([np.bincount(owner, weights=p[:, k], minlength=size) for k in range(p.shape[1])], axis=1)
    allowed = share >= SHARE * np.bincount(owner, minlength=size)[:, None]
    allowed[:, -1] = True
    return allowed[owner]


def complement_start(feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """First posteriors of the labelled documents' sentences by complement naive Bayes; the last class is "no subject"."""
    of_doc = labels[owner].astype(float)
    of_doc /= np.maximum(of_doc.sum(axis=1, keepdims=True), 1)
    table = counts(feature, sentence, of_doc)
    every = table.sum(axis=1, keepdims=True)
    rest = every - table
    seen = max(1, int((every > 0).sum()))
    background = np.log((every + SMOOTHING) / (every.sum() + SMOOTHING * seen))
    weights = background - np.log((rest + SMOOTHING) / (rest.sum(axis=0) + SMOOTHING * seen))
    weights[:, -1] = 0.0
    prior = np.zeros(table.shape[1])
    prior[-1] = 1.0
    return posteriors(feature, sentence, len(owner), weights, prior, labels[owner] | (np.arange(labels.shape[1]) == labels.shape[1] - 1))


def calibrated(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each subject slope and intercept of the log odds that a document of some score has it: a logistic fit to the labels,
    starting from what the question expects. Annotators miss some subjects and name some wrong ones; how many is fitted too."""
    start = np.array([EXPECTED_SLOPE, -EXPECTED_SLOPE * EXPECTED_CUT])
    hold = np.diag(1 / np.square(SPREAD))
    out = np.tile(start, (scores.shape[1], 1))
    for k in range(scores.shape[1]):
        x, y = np.stack([scores[:, k], np.ones(len(scores))], axis=1), labels[:, k]
        b, named, wrong = start.copy(), 0.9, 0.01
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            has, hasnt = p * np.where(y, named, 1 - named), (1 - p) * np.where(y, wrong, 1 - wrong)
            true = has / (has + hasnt)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (true - p) - hold @ (b - start))
            b = b + np.clip(step, -5, 5)
            named, wrong = (true[y].sum() + 9) / (true.sum() + 10), ((1 - true)[y].sum() + 0.1) / ((1 - true).sum() + 10)
        if b[0] > 0:
            out[k] = b
    return out


class Classifier:
    """Log weights of features and classes, prior, calibration, and the subjects' names; of fixed size."""

    def __init__(self, subjects: list[str], weights: np.ndarray, prior: np.ndarray, fit: np.ndarray) -> None:
        self.subjects, self.weights, self.prior, self.fit = subjects, weights, prior, fit

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        """For each text the mean posterior of its sentences for each subject (zeros without sentences)."""
        flat, bounds, owner = words.batch(texts)
        out = np.zeros((len(texts), len(self.subjects)))
        if len(owner):
            p = posteriors(*features(flat, bounds), len(owner), self.weights, self.prior)
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(owner, weights=p[:, k], minlength=len(texts))
            out /= np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
        return out

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        return np.where(scores > 0, 1 / (1 + np.exp(-np.clip(scores * self.fit[:, 0] + self.fit[:, 1], -30, 30))), 0.0)


def left_out(feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, p: np.ndarray, table: np.ndarray, mass: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Scores of the documents whose sentences these are, each under the model without its own counts (``p`` gave them)."""
    size = int(owner[-1]) + 1
    out = np.zeros((size, table.shape[1] - 1))
    totals, every = table.sum(axis=0), background.sum() + SMOOTHING * FEATURES
    strength = PRIOR * totals.sum() / table.shape[1] + 1e-9
    order = np.argsort(owner[sentence], kind="stable")
    feature, sentence = feature[order], sentence[order]
    ends = np.searchsorted(owner[sentence], np.arange(size + 1))
    starts = np.searchsorted(owner, np.arange(size + 1))
    for d in range(size):
        f, s = feature[ends[d] : ends[d + 1]], sentence[ends[d] : ends[d + 1]] - starts[d]
        if not len(f):
            continue
        own_p = p[starts[d] : starts[d + 1]]
        seen, at = np.unique(f, return_inverse=True)
        own = np.stack([np.bincount(at, weights=own_p[s, k], minlength=len(seen)) for k in range(table.shape[1])], axis=1)
        base = (background[seen] - np.bincount(at, minlength=len(seen)) + SMOOTHING) / every
        weights = np.log((np.maximum(table[seen] - own, 0) + strength * base[:, None]) / (totals - own.sum(axis=0) + strength))
        left = mass - own_p.sum(axis=0)
        q = posteriors(at, s, len(own_p), weights, np.log((left + 1.0) / (left.sum() + len(left))))
        out[d] = q[:, :-1].mean(axis=0)
    return out


def _labelled(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Ids, texts and label matrix (last column: none) of at most ``MAX_LABELLED`` documents, chosen by the hash of their ids."""
    names = {s.strip().lower(): n for n, s in enumerate(subjects)}
    rows = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.coalesce("subject", F.lit("")))).alias("named"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    matrix = np.zeros((len(texts), len(subjects) + 1), dtype=bool)
    for n, named in enumerate(texts.named):
        for s in named:
            if s in names:
                matrix[n, names[s]] = True
            elif s == "":
                matrix[n, -1] = True
    some = matrix.any(axis=1)
    return texts.doc_id.to_numpy()[some], [t for t, ok in zip(texts.text, some) if ok], matrix[some]


def _corpus_round(documents: DataFrame, weights: np.ndarray, prior: np.ndarray, known: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of features and classes over all documents but the labelled ones: one map, and one aggregation of a table of fixed size."""
    shared = documents.sparkSession.sparkContext.broadcast((weights, prior, known))
    classes = weights.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, prior, known = shared.value
        words = Words()
        table = np.zeros((FEATURES, classes))
        mass = np.zeros(classes)
        for pdf in batches:
            texts = [None if d in known else t for d, t in zip(pdf.doc_id, pdf.text)]
            for start in range(0, len(texts), 1000):
                flat, bounds, owner = words.batch(texts[start : start + 1000])
                if len(owner):
                    f, s = features(flat, bounds)
                    p = posteriors(f, s, len(owner), weights, prior)
                    p = posteriors(f, s, len(owner), weights, prior, within_document(p, owner))
                    table += counts(f, s, p)
                    mass += p.sum(axis=0)
        at = np.flatnonzero(table.sum(axis=1) > 0)
        if mass.sum():
            out = pd.DataFrame(np.vstack([table[at], mass]).astype(np.float64), columns=[f"c{k}" for k in range(classes)])
            out.insert(0, "feature", np.append(at, -1))
            yield out

    columns = [f"c{k}" for k in range(classes)]
    sums = documents.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").where("text is not null").mapInPandas(run, "feature int, " + ", ".join(f"{c} double" for c in columns))
    got = sums.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    shared.unpersist()
    table, mass = np.zeros((FEATURES, classes)), np.zeros(classes)
    values = got[columns].to_numpy()
    at = got.feature.to_numpy()
    table[at[at >= 0]] = values[at >= 0]
    if (at < 0).any():
        mass = values[at < 0][0]
    return table, mass


def train(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier, or None without usable labels. The list of subjects is as long as the model is wide."""
    names = sorted(r[0] for r in subjects.where("subject is not null").select("subject").distinct().collect())
    ids, texts, matrix = _labelled(documents, labels, names)
    flat, bounds, owner = Words().batch(texts)
    if not len(owner):
        return None
    feature, sentence = features(flat, bounds)
    p = complement_start(feature, sentence, owner, matrix)
    allowed = matrix[owner] | (np.arange(matrix.shape[1]) == matrix.shape[1] - 1)
    background = np.bincount(feature, minlength=FEATURES).astype(float)
    table, mass = counts(feature, sentence, p), p.sum(axis=0)
    for _ in range(LABELLED_ROUNDS):
        p = posteriors(feature, sentence, len(owner), *model(table, mass, background), allowed)
        table, mass = counts(feature, sentence, p), p.sum(axis=0)
    known = frozenset(int(i) for i in ids)
    for _ in range(CORPUS_ROUNDS):
        weights, prior = model(table, mass, background)
        p = posteriors(feature, sentence, len(owner), weights, prior, allowed)
        rest, rest_mass = _corpus_round(documents, weights, prior, known)
        table, mass = counts(feature, sentence, p) + rest, p.sum(axis=0) + rest_mass
        background = table.sum(axis=1)
    some = np.unique(owner)
    scores = left_out(feature, sentence, owner, p, table, mass, background)[some]
    return Classifier(names, *model(table, mass, background), calibrated(scores, matrix[some][:, :-1]))


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``, ``share`` (of the sentences) and ``posterior`` for each subject of each document."""
    schema = "doc_id bigint, subject string, share double, posterior double"
    known = train(documents, subjects, labels)
    if known is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast((known.subjects, known.weights, known.prior, known.fit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_ = Classifier(*shared.value)
        words = Words()
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                share = model_.scores(part.text.tolist(), words)
                sure = model_.posteriors(share)
                at, k = np.nonzero(sure >= 0.5)
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy()[at], "subject": [model_.subjects[x] for x in k], "share": share[at, k], "posterior": sure[at, k]})

    found = documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(run, schema)
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"), F.max("posterior").alias("posterior"))
