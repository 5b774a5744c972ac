"""Language identification by a linear-chain conditional random field over the words of a text.

Every word has the sum of the weights of its affixes, character n-grams and lexicon entry for each language; learned
transition weights join neighbouring words. Forward-backward gives each word its language posterior, also in texts
that switch languages; a document's language has the largest share of its words' posteriors. As posteriors are
normalised over the learned languages, texts in none of them are told by words: few of theirs are in the lexicon of the
language that the field gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import picked, slices, small_side, tidy, written

FEATURE_BITS = 17
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5], np.uint64)
#: Chunk of words that is scanned at once, words scored together, and words whose scores a worker keeps.
CHUNK, AT_ONCE, CACHED_WORDS = 32, 30_000, 100_000
UNKNOWN = "und"


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _hashed(kind: int, *chars: np.ndarray) -> np.ndarray:
    h = np.full(chars[0].shape, kind * 0x100000001B3 & (1 << 64) - 1, np.uint64)
    for k, c in enumerate(chars):
        h = (h ^ (c + np.uint64(1))) * MIX[k]
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(word, hashed feature)] for every kind of feature, lengths): n-grams of 2 and 3 with the word's ends, affixes, the word."""
    a = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = (start + size)[word] - np.arange(len(a))  # characters from here to the end of the word
    out = []
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        out.append((word[at], _hashed(n, *(a[at + k] for k in range(n)))))
    for kind, n in ((4, 4), (5, 5)):
        long = np.flatnonzero(size >= n)
        for side, at in ((0, start[long]), (1, start[long] + size[long] - n)):
            out.append((long, _hashed(10 * kind + side, *(a[at + k] for k in range(n)))))
    power = np.cumprod(np.full(size.max(), MIX[0]))
    whole = np.add.reduceat((a + np.uint64(7)) * power[np.arange(len(a)) - start[word]], start)
    out.append((np.arange(len(words)), _hashed(60, whole)))
    return out, size


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    step: np.ndarray  # (languages, languages): exp of the transition weights

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for word, feature in features(words)[0]:
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(word, self.weights[feature, k], len(words))
        return out


def _normal(x: np.ndarray, axes: tuple[int, ...] = (-1,)) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def posteriors(score: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Language posteriors of the words of several texts, sizes words each, one after another.

    Texts are cut into chunks. A chunk's transfer matrix carries the messages across it, so that all chunks of all
    texts are then scanned together, whatever a text's length; the result is that of one scan over each whole text.
    """
    k = score.shape[1]
    sizes = sizes[sizes > 0]
    chunks = -(-sizes // CHUNK)
    first = np.cumsum(chunks) - chunks
    n = int(chunks.sum())
    within = np.arange(len(score)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = np.repeat(first, sizes) + within // CHUNK, within % CHUNK
    e = np.ones((n, CHUNK, k))
    e[row, col] = np.exp(score - score.max(axis=1, keepdims=True))
    real = np.zeros((n, CHUNK), bool)
    real[row, col] = True
    over = np.broadcast_to(np.eye(k), (n, k, k))
    for t in range(CHUNK):
        over = np.where(real[:, t, None, None], _normal((over @ step) * e[:, t, None, :], (1, 2)), over)
    fore, back = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    for r in range(int(chunks.max()) - 1):
        at = first[chunks > r + 1] + r
        fore[at + 1] = _normal(np.einsum("ni,nij->nj", fore[at], over[at]))
        own = chunks > r + 1
        at = (first + chunks - 1 - r)[own]
        back[at - 1] = _normal(np.einsum("nij,nj->ni", over[at], back[at]))
    alpha = np.empty((n, CHUNK, k))
    now = fore
    for t in range(CHUNK):
        now = alpha[:, t] = _normal((now @ step) * e[:, t])
    now = back
    for t in range(CHUNK - 1, -1, -1):
        alpha[:, t] *= now  # what is behind a text's end is never read
        now = np.where(real[:, t, None], _normal((e[:, t] * now) @ step.T), now)
    return _normal(alpha[row, col])


#: Letters of a word that tells learned languages from others; shorter ones come in many.
LEAST_LETTERS = 3


@dataclass
class Lexicon:
    """Words with the languages whose documents have them, as bits, and the least share of known words in a text."""

    words: dict[str, int]
    least: float

    def bits(self, word: str) -> int:
        """The languages that have this word; -1 for a word that doesn't count."""
        return self.words.get(word, 0) if len(word) >= LEAST_LETTERS else -1

    def wanting(self, n: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Which texts, have of whose n words are known, have significantly fewer than the least share."""
        return have < self.least * n - 2 * np.sqrt(n * self.least * (1 - self.least)) - 1


class Labeller:
    """Labels the words of texts; keeps the scores and lexicon entries of words it has seen."""

    def __init__(self, model: Model, lexicon: Lexicon | None = None) -> None:
        self.model, self.lexicon = model, lexicon or Lexicon({}, 0.0)
        self.known, self.table, self.bits = {}, np.zeros((1, len(model.langs))), np.full(1, -1)

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word posteriors, words of each text, languages that have each word)."""
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.table, self.bits = {}, self.table[:1], self.bits[:1]
        new = [w for w in set().union(*words) if w not in self.known]
        own = [letters(w.decode("utf-8", "surrogatepass").lower()) for w in new]
        if named := sorted(filter(None, set(own))):
            at = dict(zip(named, range(len(self.table), len(self.table) + len(named)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(named)])
            self.bits = np.concatenate([self.bits, np.fromiter(map(self.lexicon.bits, named), np.int64, len(named))])
        self.known.update((w, at[o] if o else 0) for w, o in zip(new, own, strict=True))
        ids = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in words]
        ids = [x[x > 0] for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        every = np.concatenate([*ids, np.zeros(0, np.int64)])
        if not len(every):
            return np.zeros((0, len(self.model.langs))), sizes, every
        return posteriors(self.table[every], sizes, self.model.step), sizes, self.bits[every]

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: mean word posteriors, words, words that count, those in the lexicon of their own language."""
        p, sizes, bits = self.label(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        share = np.stack([np.bincount(doc, p[:, j], len(texts)) for j in range(p.shape[1])], axis=1).astype(float)
        share /= np.maximum(sizes, 1)[:, None]
        counts = bits >= 0
        known = counts & ((bits >> p.argmax(axis=1)) & 1 > 0)
        return share, sizes, *(np.bincount(doc, x, len(texts)) for x in (counts, known))

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, share of the words' posteriors, whether it is in none) of each text, a bounded number of words at a time."""
        at, held = 0, 0
        for k, t in enumerate([*texts, None], start=1):
            held += len(t or "") // 5 + 1
            if k > len(texts) or held > AT_ONCE:
                share, sizes, n, have = self.counted(texts[at : min(k, len(texts))])
                best, none = share.argmax(axis=1), self.lexicon.wanting(n, have) | (sizes == 0)
                for d in range(len(sizes)):
                    yield (self.model.langs[best[d]], float(min(1.0, share[d, best[d]])), bool(none[d])) if sizes[d] else (UNKNOWN, 0.0, True)
                at, held = k, 0


def word_languages(text: str, model: Model) -> list[tuple[str, str]]:
    """(word, language) of every white-space separated word of a text that has a letter."""
    p, _, _ = Labeller(model).label([text])
    words = [w for w in text.split() if letters(w)]
    return [(w, model.langs[k]) for w, k in zip(words, p.argmax(axis=1), strict=True)]


def fit(examples: list[tuple[str, list[str]]], epochs: int = 12, length: int = 64, batch: int = 512, ridge: float = 1e-5, seed: int = 7) -> Model | None:
    """A model of (language, words) examples, every word of which is used.

    Texts are cut into pieces of 8 to 64 words, which follow one another in random order, so that transitions between
    languages are seen; the whole is cut into sequences. The conditional likelihood is maximised by Adam, a batch of
    sequences a step, with exact forward-backward gradients.
    """
    examples = [(lang, ws) for lang, raw in examples if (ws := [o for w in raw if (o := letters(w.lower()))])]
    langs = sorted({lang for lang, _ in examples})
    if not langs:
        return None
    rng, number = np.random.default_rng(seed), {lang: k for k, lang in enumerate(langs)}
    vocab: dict[str, int] = {}
    pieces: list[tuple[int, np.ndarray]] = []
    for lang, ws in examples:
        ids, at = np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int32, len(ws)), 0
        while at < len(ids):
            size = int(rng.integers(8, 65))
            pieces.append((number[lang], ids[at : at + size]))
            at += size
    order = rng.permutation(len(pieces))
    x = np.concatenate([pieces[k][1] for k in order])
    y = np.repeat([pieces[k][0] for k in order], [len(pieces[k][1]) for k in order])
    rows = -(-len(x) // length)
    x, y = np.resize(x, (rows, length)), np.resize(y, (rows, length))  # the last sequence is filled from the first
    k = len(langs)
    pairs = features(list(vocab))[0]
    word, feature = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    by = np.argsort(word, kind="stable")
    feature, count = feature[by], np.bincount(word, minlength=len(vocab))
    first_of = np.cumsum(count) - count
    params = [np.zeros((1 << FEATURE_BITS, k)), np.eye(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batches = [b for _ in range(max(epochs, -(-40 * batch // rows))) for b in np.array_split(rng.permutation(rows), -(-rows // batch))]
    for turn, own in enumerate(batches, start=1):
        weights, move = params
        step, n = np.exp(move), len(own) * length
        words, at = np.unique(x[own], return_inverse=True)  # with their features, one word after another
        at = at.reshape(len(own), length)
        word = np.repeat(np.arange(len(words)), count[words])
        feature_of = feature[np.arange(len(word)) + np.repeat(first_of[words] - np.cumsum(count[words]) + count[words], count[words])]
        truth = np.eye(k)[y[own]]
        score = np.stack([np.bincount(word, weights[feature_of, j], len(words)) for j in range(k)], axis=1)[at]
        e = np.exp(score - score.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        now = np.full((len(own), k), 1 / k)
        for t in range(length):
            now = alpha[:, t] = _normal((now @ step) * e[:, t])
        now = np.full((len(own), k), 1 / k)
        for t in range(length - 1, -1, -1):
            beta[:, t] = now
            now = _normal((e[:, t] * now) @ step.T)
        wrong = (_normal(alpha * beta) - truth) / n
        both = _normal(alpha[:, :-1, :, None] * step * (e * beta)[:, 1:, None, :], (2, 3))
        seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        by_word = np.stack([np.bincount(at.ravel(), wrong[..., j].ravel(), len(words)) for j in range(k)], axis=1)
        grads = [
            np.stack([np.bincount(feature_of, by_word[word, j], 1 << FEATURE_BITS) for j in range(k)], axis=1) + ridge * weights,
            (both - seen).sum(axis=(0, 1)) / n + ridge * move,
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= 0.08 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)
    return Model(langs, params[0].astype(np.float32), np.exp(params[1]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _of_each(named: DataFrame, most: int) -> list[tuple[str, str]]:
    """(language, text) of at most most documents of each language, which hash order picks; whole texts."""
    own = written(picked(named.select("doc_id", "lang"), "lang", "doc_id", most).distinct(), "picked")
    rows = named.select("doc_id", "lang", "text").join(small_side(own), ["doc_id", "lang"]).select("lang", "text").collect()
    return sorted((r.lang, r.text) for r in rows)


def _named(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def learn(docs: DataFrame, per_lang: int = 200) -> Model | None:
    """Fits on the whole texts of at most per_lang documents of each language, none of them held out."""
    return fit([(lang, text.split()) for lang, text in _of_each(_named(docs).where(~held_out()), per_lang)])


def _labelled(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = list(labeller.documents(texts)) if labeller else [(UNKNOWN, 0.0, True)] * len(texts)
            langs, scores, _ = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text); the model alone and the text decide.

    A null text, one without a letter, or no model give und with score 0. A row with null doc_id isn't held out and
    isn't learned from. Rows may repeat; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_labelled(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _kept(model: Model | None, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, lexicon) if model else None
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = labeller.documents(texts) if labeller else [(UNKNOWN, 0.0, True)] * len(texts)
                yield part.filter(pa.array([not none for _, _, none in found], pa.bool_()))

    return tidy(run)


def in_known_languages(docs: DataFrame, model: Model | None, lexicon: Lexicon) -> DataFrame:
    """docs without texts in none of the learned languages: those that have significantly few known words for them.

    A word is known if it is in the lexicon of the language that the field gives it, so that texts which switch between
    languages stay. Texts without a letter go, null ones too, and all without a model. Every row is judged by its text
    alone, and all columns are kept as they are.
    """
    return docs.mapInArrow(_kept(model, lexicon), docs.schema)


def lexicon(docs: DataFrame, model: Model | None, per_lang: int = 200) -> Lexicon:
    """Learns words from documents as learn does; held-out documents give the share: half of what nine in ten of them have.

    A word counts if two of a language's documents have it, so that a junk text among them doesn't vouch for itself.
    """
    named = _named(docs)
    seen: dict[tuple[str, str], int] = {}
    for lang, text in _of_each(named.where(~held_out()), per_lang):
        for w in {letters(w.lower()) for w in text.split()}:
            seen[lang, w] = seen.get((lang, w), 0) + 1
    words: dict[str, int] = {}
    for (lang, w), n in seen.items():
        if n > 1:
            words[w] = words.get(w, 0) | 1 << model.langs.index(lang)
    if model is None:
        return Lexicon({}, 0.0)
    _, _, n, have = Labeller(model, Lexicon(words, 0.0)).counted([text for _, text in _of_each(named.where(held_out()), per_lang // 4)])
    shares = have[n >= 10] / n[n >= 10]
    return Lexicon(words, float(np.quantile(shares, 0.1)) / 2 if len(shares) else 0.0)
