"""Abusive, hateful or sexual content (problem 8).

A chain of linear classifiers reads each sentence: sexual, threatening, hateful, insulting, and last whether the sentence
is abusive at all. Each link sees the words of the sentence and the probabilities of the links before it; in training
these are out-of-fold predictions. A document scores as its worst sentence.

Labels exist per document only. The sentence that makes a labelled document abusive is found by alternating: score the
sentences, take each document's worst, train again, and drop labelled documents without any suspicious sentence (labels
are wrong at times). The first four categories carry no labels in the data. Seed words name the category of some of the
worst sentences; a model of their other words, which never sees a seed, then judges every worst sentence, so that a
category is learnt from its phrasing and not from the list.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.leaks import spread

CATEGORIES = ("sexual", "threat", "hate", "insult", "abusive")
POSITIVES, NEGATIVES = 4_000, 12_000  #: the most labelled documents of either verdict that training looks at
SENTENCES = 200  #: the most sentences of one of them that training looks at, evenly spread (scoring reads all)
CLEAN_WEIGHT = 5.0  #: the most that a clean document of the sample weighs in the fit
LEAST_POSITIVES = 5  #: abusive documents that the choice of a threshold needs

# Seed words of the categories, in English, German, French and Spanish.
SEEDS = {
    "sexual": "sex nude naked porn xxx cock tits horny nipples thighs crotch fuck nackt ficken titten geil baiser seins nue desnuda follar tetas polla",
    "threat": "kill drown burn beating throat choke beat stab strangle verprugeln umbringen erwurgen abstechen tuer creve egorger matar muerete ahogarte",
    "hate": "vermin parasites subhuman plague diseased whores thieves cripples ungeziefer parasiten untermenschen vermine racaille basura ratas sucios",
    "insult": "stupid idiot moron imbecile dumb dumbass bastard asshole bitch cretin maggot scumbag scum coward worthless brainless arschloch missgeburt dummkopf connard salope debile cabron imbecil gilipollas",
}

_HIDDEN = re.compile(r"[­​-‏‪-‮⁠-⁤﻿]")
# Only tags go: of a known name, or with name=value pairs alone. Words between other angle brackets are text.
_TAGS = "a abbr article aside audio b blockquote body br button center cite code dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav ol option p pre q s script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul video"
_PAIR = r"""\s+[a-z][\w:\-]{0,40}\s?=\s?(?:"[^"<>]{0,200}"|'[^'<>]{0,200}'|[^\s"'<>]{1,200})"""
_MARKUP = re.compile(rf"(?i:</?(?:(?:{_TAGS.replace(' ', '|')})\s?/?|[a-z][\w:\-]{{0,40}}(?:{_PAIR}){{1,20}}\s?/?)>)|&[a-z]{{2,6}};|\\n|\\\"", re.ASCII)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|[\n\r]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_@$](?:[ .\-_*·][^\W_]|[ .\-_*·][@$]){2,}(?![^\W_])")
_TOKEN = re.compile(r"[\w@$*!|]+")
_RUN = re.compile(r"(.)\1+")
_LEET = str.maketrans({"@": "a", "$": "s", "!": "i", "|": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
# Cyrillic and Greek letters that look like Latin ones.
_TWINS = str.maketrans("\u0430\u0435\u043e\u0440\u0441\u0445\u0443\u043a\u043c\u0442\u0432\u043d\u0456\u0458\u0455\u0501\u03bf\u03b1\u03b5\u03b9\u03ba\u03bd\u03c1\u03c4\u03c5\u03c7", "aeopcxykmtbhijsdoaeikvptux")
_SPELT = "zzspeltzz"  #: stands before letters that were spelt out
_LATIN = re.compile("[a-z]")
_WINDOW, _STEP = 24, 12
DECAY = 3e-5  #: how strongly weights are drawn to zero
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _read(token: str) -> tuple[str, ...]:
    """What a single token in lower case stands for: look-alike signs read as letters, repeats collapsed, masks marked."""
    token = token.strip("!|_")
    if not token:
        return ()
    if token == _SPELT:
        return ("<spelt>",)
    if token.isdigit():
        return ("<num>",)
    if "*" in token.strip("*"):
        return "<mask>", _RUN.sub(r"\1", f"{token[0]}*{token[-1]}{len(token)}")
    if not token.isascii() and (twin := token.translate(_TWINS)) != token and _LATIN.search(token):
        return "<twin>", _RUN.sub(r"\1", twin.translate(_LEET))
    if not token.isalpha() and any(c.isalpha() for c in token):
        return (_RUN.sub(r"\1", token.replace("*", "").translate(_LEET)),)
    return (_RUN.sub(r"\1", token),)


def _joined(m: re.Match) -> str:
    word = re.sub(r"[ .\-_*·]", "", m.group())
    # The letters may begin with a one-letter word of their own.
    return f" {_SPELT} {word} {word[1:]} "


class _Reader(dict):
    """What each token stands for, remembered; emptied when it grows large."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        self[token] = read = _read(token)
        return read


_READ = _Reader()


def _bare(text: str) -> str:
    """In lower case, without accents."""
    return (text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))).lower()


def plain_tokens(sentence: str) -> list[str]:
    """Words with disguises taken off: spelt-out letters joined, look-alike signs read as letters, repeats collapsed."""
    return [word for token in _TOKEN.findall(_SPACED.sub(_joined, _bare(sentence))) for word in _READ[token]]


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as tokens; long ones in overlapping windows."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "&" in text or "\\" in text:
        text = _MARKUP.sub(" \n ", text)
    text = _bare(text)
    spaced = _SPACED.search(text) is not None
    out = []
    for part in _SENTENCE.split(text):
        tokens = [word for token in _TOKEN.findall(_SPACED.sub(_joined, part) if spaced else part) for word in _READ[token]]
        if len(tokens) > _WINDOW + _STEP:
            out += [tokens[i : i + _WINDOW] for i in range(0, len(tokens) - _STEP, _STEP)]
        elif tokens:
            out.append(tokens)
    return out


class Features:
    """Hashed words and word pairs of sentences, as 64-bit numbers."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def word(self, token: str) -> int:
        if token not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = int.from_bytes(blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        return self.known[token]

    def of(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all sentences in a row, and the sentence each belongs to."""
        sizes = np.array([len(p) for p in parts], np.int64)
        words = np.array([self.word(t) for p in parts for t in p], np.uint64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        if len(words) < 2:
            return words, owner
        same = owner[1:] == owner[:-1]
        pairs = (words[:-1] * np.uint64(_M1) + words[1:] * np.uint64(_M2))[same]
        pairs ^= pairs >> np.uint64(31)
        return np.concatenate([words, pairs]), np.concatenate([owner, owner[1:][same]])


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("i,i->", a, b))  # of vectors this long a threaded library makes idle threads spin


def _times(extra: np.ndarray, w: np.ndarray) -> np.ndarray | float:
    return sum(extra[:, j] * w[j] for j in range(extra.shape[1])) if extra.shape[1] else 0.0


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, fall: float = 1e-4, turns: int = 40, decay: float = DECAY) -> np.ndarray:
    """Weights of a logistic regression over sparse features, dense ``extra`` columns and a constant, by L-BFGS.

    It stops when a step makes the loss fall by less than the share ``fall`` of it.
    """
    total, sign = weight.sum(), 2 * y - 1
    w = np.zeros(width + extra.shape[1] + 1)
    w[-1] = np.log((_dot(weight, y) + 1) / (_dot(weight, 1 - y) + 1))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, w[cols], n) + _times(extra, w[width:-1]) + w[-1]
        e = -sign * weight / (1 + np.exp(np.clip(sign * z, -30, 30))) / total
        g = np.concatenate([np.bincount(cols, e[rows], width), [_dot(x, e) for x in extra.T], [e.sum()]])
        g[:-1] += decay * w[:-1]
        return _dot(weight, np.logaddexp(0, -sign * z)) / total + decay / 2 * _dot(w[:-1], w[:-1]), g

    at, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(turns):
        step, alphas = g.copy(), []
        for s, d, r in reversed(past):
            alphas.append(r * _dot(s, step))
            step -= alphas[-1] * d
        if past:
            s, d, r = past[-1]
            step /= r * _dot(d, d)
        else:
            step /= max(1e-12, np.sqrt(_dot(g, g)))
        for (s, d, r), a in zip(past, reversed(alphas), strict=True):
            step += (a - r * _dot(d, step)) * s
        slope, size = _dot(g, step), 1.0
        while True:
            new, h = loss(w - size * step)
            if new <= at - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, d = -size * step, h - g
        w, g, before, at = w + s, h, at, new
        if (curve := _dot(s, d)) > 1e-14:
            past = [*past[-7:], (s, d, 1 / curve)]
        if before - at < fall * before:
            break
    return w


def _prob(rows: np.ndarray, cols: np.ndarray, n: int, w: np.ndarray, width: int, extra: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + _times(extra, w[width : width + extra.shape[1]]) + w[-1], -30, 30)))


class ChainModel:
    """A fitted chain: feature keys (sorted), one weight vector per category, and the document threshold."""

    def __init__(self, keys: np.ndarray, weights: list[np.ndarray], cut: float):
        self.keys, self.weights, self.cut = keys, weights, cut

    def _columns(self, features: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, features), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == features if len(self.keys) else np.zeros(len(features), bool)
        return owner[hit], at[hit]

    def sentence_scores(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(sentences, categories): probabilities, each link fed with those before it."""
        rows, cols = self._columns(features, owner)
        out = np.zeros((n, len(self.weights)))
        for c, w in enumerate(self.weights):
            out[:, c] = _prob(rows, cols, n, w, len(self.keys), out[:, :c])
        return out


def _best_cut(score: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The threshold of the best F1 over held-out scores, in the middle of the gap below it."""
    if not len(score):
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(1 - y[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    best = int(np.argmax(f1))
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0.0)) / 2)


def _seeded(features: np.ndarray, owner: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which features of one document (its words, then its pairs of neighbours) are seed words or pairs with one."""
    words = (len(features) + int(owner.max()) + 1) // 2 if len(features) else 0
    hit = np.isin(features[:words], seeds)
    same = owner[1:words] == owner[: max(0, words - 1)]
    return np.concatenate([hit, (hit[1:] | hit[:-1])[same]]) if words > 1 else hit


class _Sentences:
    """Sentences as sparse rows over ``keys``, with equal ones of one fold and one set of labels taken together."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int, *labels: np.ndarray):
        # Sums of 32-bit numbers are exact in doubles; two of them and the labels make one hash of 64 bits.
        kind = np.zeros(n, np.uint64)
        for column in (*(np.bincount(rows, ((cols + 1) * m & 0xFFFFFFFF) * 1.0, n) for m in (0x9E3779B1, 0x85EBCA77)), *labels):
            kind = (kind ^ column.astype(np.uint64)) * np.uint64(_M1)
            kind ^= kind >> np.uint64(29)
        _, first, self.group = np.unique(kind, return_index=True, return_inverse=True)
        self.n, self.width, self.first = len(first), width, first
        keep = np.zeros(n, bool)
        keep[first] = True
        hit = keep[rows]
        self.rows, self.cols = self.group[rows[hit]], cols[hit]

    def summed(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, weight, self.n)

    def fit(self, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, fall: float = 1e-4) -> np.ndarray:
        return _fit(self.rows, self.cols, self.n, self.width, extra, y, weight, fall)

    def out_of_fold(self, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, folds: int, fall: float = 1e-4) -> np.ndarray:
        """Each sentence's probability by a model that saw none of its fold."""
        out = np.zeros(self.n)
        for k in range(folds):
            w = self.fit(extra, y, weight * (part != k), fall)
            own = part == k
            out[own] = _prob(self.rows, self.cols, self.n, w, self.width, extra)[own]
        return out


def train(doc: np.ndarray, toxic: np.ndarray, features: np.ndarray, owner: np.ndarray, sentence_doc: np.ndarray, clean_weight: float = 1.0, folds: int = 3, seeded: np.ndarray | None = None, chained: bool = True) -> ChainModel:
    """Fit a chain. ``toxic``: verdict per document; ``sentence_doc``: document of each sentence; features as in Features;
    ``clean_weight``: how many clean documents each sampled one stands for (more than CLEAN_WEIGHT count as that in the
    fit, but not in the choice of the threshold); ``seeded``: the features that are seed words or pairs with one.

    A worst sentence belongs to a category when it has one of its seed words or when its other words say so: a model of
    the context alone, taught by the seeded sentences without their seeds, judges all sentences out of fold.

    Training happens on a bounded sample and is deterministic. Seed words enter as light examples of their category, so a
    sample with few or no abusive documents still yields a (weaker) model; with fewer than LEAST_POSITIVES sure ones no
    threshold can be chosen and it is 0.5. ``chained`` off feeds no earlier probabilities (for comparison).
    """
    f = Features()
    seeds = [(c, f.word(plain_tokens(w)[0])) for c, words in SEEDS.items() for w in words.split()]
    seed_keys = np.array([h for _, h in seeds], np.uint64)
    n_docs, n = len(toxic), len(sentence_doc)
    seeded = np.isin(features, seed_keys) if seeded is None else seeded
    positive = toxic[sentence_doc] == 1 if n else np.zeros(0, bool)
    # A first guess at the worst sentences: log odds of features by documents that have them.
    every, col = np.unique(features, return_inverse=True)
    seen = np.divmod(np.unique(sentence_doc[owner] * len(every) + col), max(1, len(every))) if n else np.zeros((2, 0), np.int64)
    is_pos = toxic[seen[0]] == 1 if n else np.zeros(0, bool)
    odds = np.log((np.bincount(seen[1][is_pos], minlength=len(every)) + 0.3) / (np.bincount(seen[1][~is_pos], minlength=len(every)) + 0.3) * max(1, n_docs - toxic.sum()) / max(1, toxic.sum()))
    seed_at = np.isin(every, seed_keys)
    score = np.bincount(owner, np.clip(odds, -2, 4)[col] + 2.0 * seed_at[col], n)
    score = score / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n))) if n else score
    fold = (doc.astype(np.uint64) * np.uint64(_M1) >> np.uint64(40)) % np.uint64(folds)
    keep = np.ones(n_docs, bool)
    for turn in range(3):
        # The worst sentence of every kept positive document.
        order = np.lexsort((np.arange(n), -score, sentence_doc))
        first = order[np.unique(sentence_doc[order], return_index=True)[1]] if n else order
        chosen = first[positive[first] & keep[sentence_doc[first]]] if n else first
        use = ~positive & keep[sentence_doc] if n else positive
        use[chosen] = True
        mark = np.zeros(n, bool)
        mark[chosen] = True
        keys = np.union1d(np.unique(features[mark[owner]]), seed_keys).astype(np.uint64)
        at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
        hit = keys[at] == features
        # Seed words follow as sentences of one word.
        rows = np.concatenate([owner[hit], n + np.arange(len(seeds))])
        cols = np.concatenate([at[hit], np.searchsorted(keys, seed_keys)])
        bare = np.concatenate([~seeded[hit], np.zeros(len(seeds), bool)])
        size = n + len(seeds)
        weight = np.concatenate([use * min(clean_weight, CLEAN_WEIGHT), np.full(len(seeds), 0.2)])
        weight[:n][mark] = 3.0
        part = np.concatenate([fold[sentence_doc], np.full(len(seeds), folds)]) if n else np.full(len(seeds), folds)
        abusive = np.concatenate([mark, np.ones(len(seeds), bool)])
        y = np.zeros((size, len(CATEGORIES)))
        y[:, -1] = abusive
        last = turn == 2
        if last:
            # The categories are needed only once the worst sentences are settled.
            named = np.zeros((size, len(CATEGORIES) - 1), bool)
            for c, name in enumerate(CATEGORIES[:-1]):
                own = np.isin(keys, np.array([h for k, h in seeds if k == name], np.uint64))
                named[:n, c] = mark & (np.bincount(rows[own[cols]], minlength=size)[:n] > 0)
                named[n:, c] = [k == name for k, _ in seeds]
            y[:, :-1] = named | _by_context(rows[bare], cols[bare], size, len(keys), mark, named, part, folds)
        s = _Sentences(rows, cols, size, len(keys), part.astype(float), weight > 0, *y.T)
        weight, part, y = s.summed(weight), part[s.first], y[s.first]
        fed = np.zeros((s.n, len(CATEGORIES)))
        for c in range(len(CATEGORIES)) if last else [len(CATEGORIES) - 1]:
            before = fed[:, : c if last and chained else 0]
            # Which sentence is a document's worst is settled by the order of the scores, long before they stand still.
            fed[:, c] = s.out_of_fold(before, y[:, c], weight, part, folds, 1e-4 if last else 3e-3)
            fed[part == folds, c] = y[part == folds, c]
        held = score = fed[s.group, -1][:n]
        worst = np.zeros(n_docs)
        np.maximum.at(worst, sentence_doc, held)
        if not last:
            # Documents called abusive that held-out scores don't tell from clean ones are left out of the next turn.
            keep = (toxic == 0) | (worst >= _best_cut(worst, toxic, clean_weight) * (0.7 if turn == 0 else 1.0))
    weights = [s.fit(fed[:, :c] * chained, y[:, c], weight) for c in range(len(CATEGORIES))]
    sure = keep & (toxic == 1)
    cut = _best_cut(worst[keep], toxic[keep], clean_weight) if sure.sum() >= LEAST_POSITIVES else 0.5
    return ChainModel(keys, weights, float(np.clip(cut, 0.03, 0.9)))


def _by_context(rows: np.ndarray, cols: np.ndarray, size: int, width: int, mark: np.ndarray, named: np.ndarray, part: np.ndarray, folds: int) -> np.ndarray:
    """Which marked sentences belong to a category by the words around its seeds (features without seeds), out of fold.

    Sentences with seeds teach: those of the category against those of the others.
    """
    out = np.zeros(named.shape, bool)
    marked = np.concatenate([mark, np.zeros(size - len(mark), bool)])
    for c in range(named.shape[1]):
        taught = marked & named.any(axis=1)
        if not (taught & named[:, c]).any() or not (taught & ~named[:, c]).any():
            continue
        hit = marked[rows]
        place = np.cumsum(marked) - 1
        s = _Sentences(place[rows[hit]], cols[hit], int(marked.sum()), width, part[marked].astype(float), taught[marked], named[marked, c])
        p = s.out_of_fold(np.zeros((s.n, 0)), named[marked, c][s.first] * 1.0, s.summed(taught[marked] * 1.0), part[marked][s.first], folds)
        out[marked, c] = p[s.group] >= 0.5
    return out


def _labelled(documents: DataFrame, labels: DataFrame, positives: int, negatives: int) -> tuple[DataFrame, float]:
    """doc_id, toxic and text of a bounded sample of documents whose verdicts agree, chosen by a hash of the id.

    Also how many clean documents each of the sample stands for, against one abusive document.
    """
    votes = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").select("doc_id", "toxic")
    of_kind = {r.toxic: r.n for r in votes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = [max(1.0, of_kind.get(k, 0) / most) for k, most in ((0, negatives), (1, positives))]
    order = F.xxhash64("doc_id")
    sample = votes.filter("toxic = 1").orderBy(order, "doc_id").limit(positives).unionByName(votes.filter("toxic = 0").orderBy(order, "doc_id").limit(negatives))
    # At most positives + negatives rows of two numbers: a proven bound for the broadcast.
    return documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id"), stands[0] / stands[1]


def fit(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, chained: bool = True) -> ChainModel:
    """Train on at most ``positives`` + ``negatives`` labelled documents; sentences are read on the executors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            out = ([], [], [], [])
            for key, toxic, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                parts = sentences(text)
                parts = parts[:: -(-len(parts) // SENTENCES)] if len(parts) > SENTENCES else parts
                if parts:
                    features, owner = f.of(parts)
                    for column, value in zip(out, (key, toxic, features.view(np.int64), owner), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int32()))], names=["doc_id", "toxic", "features", "owner"])

    sample, clean_weight = _labelled(documents, labels, positives, negatives)
    got = sample.mapInArrow(read, "doc_id bigint, toxic int, features array<bigint>, owner array<int>").toArrow().sort_by("doc_id")
    doc, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    features = got["features"].combine_chunks().flatten().to_numpy().view(np.uint64) if len(doc) else np.zeros(0, np.uint64)
    owners = got["owner"].combine_chunks()
    base, flat, which, masks = 0, [], [], []
    known = Features()
    seeds = np.array([known.word(plain_tokens(w)[0]) for words in SEEDS.values() for w in words.split()], np.uint64)
    upto = 0
    for i, part in enumerate(owners):
        own = np.asarray(part.values)
        masks.append(_seeded(features[upto : upto + len(own)], own, seeds))
        upto += len(own)
        flat.append(own.astype(np.int64) + base)
        count = int(own.max()) + 1
        which.append(np.full(count, i))
        base += count
    owner = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    return train(doc, toxic, features, owner, np.concatenate(which) if which else np.zeros(0, np.int64), clean_weight, seeded=np.concatenate(masks) if masks else np.zeros(0, bool), chained=chained)


SCHEMA = "doc_id bigint, source string, score double, " + ", ".join(f"{c} double" for c in CATEGORIES[:-1])


def score(documents: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id, source, score (the worst sentence's) and the categories' probabilities in the document.

    Null, blank and wordless texts score 0. Each document is scored where it is read, whole, without a shuffle. Columns
    beyond doc_id, source and text are ignored; rows with a null id keep it; an empty table gives an empty result.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, f = ChainModel(*sent.value), Features()
        for batch in batches:
            parts, which = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                own = sentences(text) if text else []
                parts += own
                which += [i] * len(own)
            out = np.zeros((batch.num_rows, len(CATEGORIES)))
            if parts:
                features, owner = f.of(parts)
                np.maximum.at(out, np.array(which), chain.sentence_scores(features, owner, len(parts)))
            out = out.round(9)
            cols = [batch["doc_id"], batch["source"].cast(pa.string()), pa.array(out[:, -1]), *(pa.array(out[:, c]) for c in range(len(CATEGORIES) - 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "score", *CATEGORIES[:-1]])

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, SCHEMA)


def flagged(scores: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id of the documents at or above the model's threshold."""
    return scores.filter(F.col("doc_id").isNotNull() & (F.col("score") >= model.cut)).select("doc_id").distinct()


def rates(scores: DataFrame, model: ChainModel) -> DataFrame:
    """Per source (trimmed, lower case; null stays null): documents, flagged ones, their share and the mean score."""
    key = F.regexp_replace(F.lower("source"), r"(?U)^\s+|\s+$", "")
    hit = (F.col("score") >= model.cut).cast("int")
    return scores.groupBy(key.alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).cast("bigint").alias("n_flagged"), F.round(F.avg(hit), 6).alias("flagged_rate"), F.round(F.avg("score"), 6).alias("mean_score"), *(F.sum(((F.col(c) >= 0.5) & (hit == 1)).cast("int")).cast("bigint").alias(f"n_{c}") for c in CATEGORIES[:-1]))
