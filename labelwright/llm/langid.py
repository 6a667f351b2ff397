"""Language of texts, code-switched ones too: a linear-chain conditional random field labels every word.

Word features are affixes, character bigrams and trigrams, the word itself and the languages whose lexicon lists it, hashed into
one weight table; a matrix of transitions is learnt with them. Training follows the gradient of the sequences' likelihood on a bounded sample; its
sequences join stretches of different texts, so switching is learnt as well as staying. Forward-backward gives every word's
probabilities, and a text's language is the one with the largest mean over its words with letters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import hold, slices
from labelwright.llm.fitting import held_out, sample, texts_of
from labelwright.llm.words import mix, powers

BITS = 15
#: Learnt from at most this many texts of each language.
TEXTS_PER_LANGUAGE = 300
EPOCHS, RATE, STRETCH, LENGTH = 15, 0.3, 16, 64
#: A word is in a language's lexicon if this many of its sample texts have it.
LISTED = 3
#: Words that one step of forward-backward's memory spans; longer texts are joined exactly by the products of their blocks.
BLOCK = 1024
#: Text that is labelled at once.
BYTES = 1 << 20
#: Words (and their characters) featured at once, and words that one worker keeps scored, with the longest.
AT_ONCE, CHARS_AT_ONCE, CACHE, LONGEST_KEPT = 20_000, 1 << 18, 200_000, 64
#: The words one worker has scored: places in a table, and the table. It belongs to one field at a time.
_SEEN: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def bare(word: str) -> str:
    """A word's letters, in lower case."""
    return "".join(filter(str.isalpha, word.lower()))


def features(words: list[str], lexicon: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, joined, and where each word's begin, with the end. A word without letters has none.

    ``lexicon``: a number for the languages that list a word.
    """
    letters = [bare(w) for w in words]
    shown = [f"<{w}>" for w in letters]
    size = np.fromiter(map(len, shown), np.int64, len(shown))
    code = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    begin = end - size
    word = np.repeat(np.arange(size.size), size)
    left = end[word] - np.arange(code.size)  # characters up to the word's end
    up, down = powers(code.size + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code + np.uint64(7)) * up[:-1])])

    def hashed(kind: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (mix((sums[e] - sums[s]) * down[s] + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)

    found = []
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        found.append((word[at], hashed(n, at, at + n)))
    every = np.flatnonzero(size > 2)
    found.append((every, hashed(1, begin[every], end[every])))
    for n in (3, 4, 5):
        long = np.flatnonzero(size > n)
        found += [(long, hashed(10 + n, begin[long], begin[long] + n)), (long, hashed(20 + n, end[long] - n, end[long]))]
    if lexicon:
        listed = np.fromiter((lexicon.get(w, 0) for w in letters), np.uint64, len(words))
        known = np.flatnonzero(listed)
        found.append((known, (mix(listed[known] + np.uint64(99 << 32)) >> np.uint64(64 - BITS)).astype(np.int32)))
    owner, feature = (np.concatenate(x) for x in zip(*found, strict=True))
    lettered = size[owner] > 2
    owner, feature = owner[lettered], feature[lettered]
    order = np.argsort(owner, kind="stable")
    return feature[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=size.size))])


def emissions(weights: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each word's score for each language: the sum of its features' weights."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((at.size - 1, weights.shape[1]), np.float32)
    if some.size:
        out[some] = np.add.reduceat(weights.astype(np.float32)[feature], at[:-1][some], axis=0)
    return out


def chunked(words: list[str]) -> Iterator[list[str]]:
    """Runs of words that are few and short enough to be featured at once; a longer word is a run of its own."""
    own, size = [], 0
    for word in words:
        if own and (len(own) >= AT_ONCE or size + len(word) > CHARS_AT_ONCE):
            yield own
            own, size = [], 0
        own.append(word)
        size += len(word)
    if own:
        yield own


def _gains(scores: np.ndarray) -> np.ndarray:
    return np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64))


def _through(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each block (all of one size but for the last ones) makes of each first label: rows that sum to 1, and their logarithms' scale."""
    k = ways.shape[0]
    state, scale = np.broadcast_to(np.eye(k), (begin.size, k, k)).copy(), np.zeros((begin.size, k))
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        moved = (state[on] @ ways if t else state[on]) * _gains(scores[begin[on] + t])[:, None, :]
        total = np.maximum(moved.sum(2, keepdims=True), 1e-300)
        state[on], scale[on] = moved / total, scale[on] + np.log(total[:, :, 0])
    return state, scale


def _messages(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the blocks of whole sequences, in order: what comes in from the left, and from the right."""
    k = ways.shape[0]
    into, back = np.ones((begin.size, k)), np.ones((begin.size, k))
    several = np.flatnonzero((np.diff(owner, prepend=-1) == 0) | (np.diff(owner, append=-1) == 0))
    state, scale = np.zeros((begin.size, k, k)), np.zeros((begin.size, k))
    for at in range(0, several.size, 512):
        own = several[at : at + 512]
        state[own], scale[own] = _through(scores, begin[own], size[own], ways)
    scale = np.exp(scale - scale.max(1, keepdims=True))
    for i in several.tolist():
        if i + 1 < owner.size and owner[i + 1] == owner[i]:
            into[i + 1] = ((into[i] * scale[i]) @ state[i]) @ ways
            into[i + 1] /= into[i + 1].sum()
    for i in several[::-1].tolist():
        if i and owner[i - 1] == owner[i]:
            back[i - 1] = ways @ (scale[i] * (state[i] @ back[i]))
            back[i - 1] /= back[i - 1].sum()
    return into, back


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word of sequences laid end to end, and expected counts of moves if asked for.

    Sequences are whole, however long. One above ``block`` words goes in blocks: the product of a block's moves and scores says
    what reaches the next one from either side, which gives the same probabilities as one pass and lets blocks run side by
    side. Counts of moves are only kept for sequences in one block, as training has them.
    """
    k = scores.shape[1]
    ways = np.exp(moves - moves.max())
    begin = np.cumsum(sizes) - sizes
    into = after = None
    if sizes.max(initial=0) > block:
        if pairs:
            raise ValueError(f"counts of moves need sequences of at most {block} words")
        n = -(-sizes // block)
        owner = np.repeat(np.arange(sizes.size), n)
        nth = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
        begin = begin[owner] + nth * block
        sizes = np.minimum(block, sizes[owner] - nth * block)
        into, after = _messages(scores, begin, sizes, owner, ways)
    out, counts = np.zeros(scores.shape, np.float32), np.zeros((k, k))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for at in range(0, order.size, 512):
        own = order[at : at + 512]
        first, size = begin[own], sizes[own]
        running = size.size - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        ahead, gain = [], []
        state = None
        for t, n in enumerate(running.tolist()):
            e = _gains(scores[first[:n] + t])
            if state is not None:
                state = (state[:n] @ ways) * e
            else:
                state = e if into is None else into[own] * e
            state = state / state.sum(1, keepdims=True)
            ahead.append(state)
            gain.append(e)
        back = np.ones((0, k))
        for t in range(size[0] - 1, -1, -1):
            n = running[t]
            if n > len(back):
                back = np.concatenate([back, np.ones((n - len(back), k)) if after is None else after[own[len(back) : n]]])
            both = ahead[t] * back
            out[first[:n] + t] = both / both.sum(1, keepdims=True)
            if t:
                right = gain[t] * back
                if pairs:
                    joint = ahead[t - 1][:n, :, None] * ways * right[:, None, :]
                    counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                back = right @ ways.T
                back = back / back.sum(1, keepdims=True)
    return out, counts


@dataclass
class Field:
    """A fitted field: languages, feature weights, moves, lexicon. 2 ** BITS weights a language; the lexicon has words of the sample only."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scored(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score for each language, and 1 if it has letters."""
        out = [np.zeros((0, len(self.languages) + 1), np.float32)]
        for some in chunked(words):
            feature, at = features(some, self.lexicon)
            out.append(np.column_stack([emissions(self.weights, feature, at), np.diff(at) > 0]).astype(np.float32))
        return np.concatenate(out)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of different words and whether they have letters, from the cache or anew."""
        hold(f"language {self.name}", _SEEN.clear)
        places, table = _SEEN.get("words", ({}, self.scored([])))
        new = [w for w in words if w not in places]
        if len(table) + len(new) > CACHE:
            places, table, new = {}, table[:0], words
        if len(new) > CACHE:
            _SEEN.clear()
            mine = self.scored(new)
        else:
            if new:
                places.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, self.scored(new)])
            mine = table[np.fromiter(map(places.__getitem__, words), np.int64, len(words))]
            for w in filter(lambda w: len(w) > LONGEST_KEPT, new):
                del places[w]
            _SEEN["words"] = places, table
        return mine[:, :-1], mine[:, -1] > 0

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.string()))
        codes = lists.flatten().dictionary_encode()
        scores, lettered = self.rows(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = codes.indices.to_numpy()
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        chances, _ = forward_backward(scores[index], counts, self.moves)
        chances *= lettered[index][:, None]
        some = np.flatnonzero(counts)
        sums = np.zeros((len(texts), chances.shape[1] + 1))
        if some.size:
            begins = lists.offsets.to_numpy()[:-1][some]
            sums[some, :-1] = np.add.reduceat(chances, begins, axis=0, dtype=np.float64)
            sums[some, -1] = np.add.reduceat(lettered[index], begins, dtype=np.int64)
        best = sums[:, :-1].argmax(1)
        names = [self.languages[b] if n > 0.5 else "und" for b, n in zip(best.tolist(), sums[:, -1].tolist(), strict=True)]
        shares = [min(1.0, max(0.0, s[b] / s[-1])) if s[-1] > 0.5 else 0.0 for s, b in zip(sums, best.tolist(), strict=True)]
        return names, shares


def listed(words: list[str], index: np.ndarray, text: np.ndarray, truth: np.ndarray, k: int) -> dict[str, int]:
    """The lexicon: for each word that ``LISTED`` texts of a language have, a hash of all languages of which that holds."""
    once = np.unique((text * np.int64(len(words)) + index) * np.int64(k) + truth)
    pair, n = np.unique(once % (len(words) * np.int64(k)), return_counts=True)
    lists: dict[str, set[int]] = {}
    for word, language in zip((pair[n >= LISTED] // k).tolist(), (pair[n >= LISTED] % k).tolist(), strict=True):
        if name := bare(words[word]):
            lists.setdefault(name, set()).add(language)
    return {name: zlib.crc32(",".join(map(str, sorted(own))).encode()) + 1 for name, own in lists.items()}


def fit(labelled: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """A field for (text, language) rows, by AdaGrad on the likelihood of joined stretches."""
    languages = sorted({y for _, y in labelled})
    if not languages:
        return Field([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    k, rng = len(languages), np.random.default_rng(seed)
    lists = pc.ascii_split_whitespace(pa.array([t for t, _ in labelled], pa.string()))
    codes = lists.flatten().dictionary_encode()
    index = codes.indices.to_numpy()
    counts = np.diff(lists.offsets.to_numpy())
    truth = np.repeat([languages.index(y) for _, y in labelled], counts)
    words = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
    lexicon = listed(words, index, np.repeat(np.arange(counts.size), counts), truth, k)
    parts = [features(some, lexicon) for some in chunked(words)]
    feature = np.concatenate([f for f, _ in parts]) if parts else np.zeros(0, np.int32)
    at = np.append(0, np.cumsum(np.concatenate([np.diff(a) for _, a in parts]) if parts else np.zeros(0, np.int64)))
    lettered = np.diff(at)[index] > 0
    index, truth = index[lettered], truth[lettered]
    whole = index.size // STRETCH * STRETCH
    stretches = rng.permutation(whole // STRETCH) if whole else np.zeros(0, int)
    words = (stretches[:, None] * STRETCH + np.arange(STRETCH)).ravel() if whole else np.arange(index.size)
    index, truth = index[words], truth[words]
    sizes = np.full(-(-index.size // LENGTH), LENGTH)
    if sizes.size:
        sizes[-1] = index.size - LENGTH * (sizes.size - 1)
    weights, moves = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full(weights.shape, 1e-14), np.full(moves.shape, 1e-14)
    starts = np.cumsum(sizes) - sizes
    follow = np.setdiff1d(np.arange(index.size), starts)
    real = np.zeros((k, k))
    np.add.at(real, (truth[follow - 1], truth[follow]), 1)
    owner = np.repeat(np.arange(at.size - 1), np.diff(at))
    total = max(1, index.size)
    for _ in range(epochs):
        chances, expected = forward_backward(emissions(weights, feature, at)[index], sizes, moves, pairs=True)
        chances[np.arange(truth.size), truth] -= 1
        for c in range(k):
            by_word = np.bincount(index, chances[:, c], at.size - 1)
            g = np.bincount(feature, by_word[owner], 1 << BITS) / total + 1e-7 * weights[:, c]
            seen_w[:, c] += g * g
            weights[:, c] -= RATE * g / np.sqrt(seen_w[:, c])
        g = (expected - real) / total
        seen_m += g * g
        moves -= RATE * g / np.sqrt(seen_m)
    return Field(languages, weights.astype(np.float32), moves, lexicon)


def train(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> Field:
    """Learn from text and non-null lang of rows outside the held-out fold: at most ``per_language`` texts or so of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = sample(rows.select("doc_id", "lang"), "lang", per_language)
    return fit(texts_of(docs, chosen, "lang", "string") if chosen else [])


def identify(docs: DataFrame, model: Field, column: str = "language") -> DataFrame:
    """The rows with a struct (lang_pred, score) named ``column``: ``und`` and 0 for null texts and texts without a letter.

    Only the text is looked at. Repeated rows and null ids stay, and so do other columns whatever their names, but one named
    ``column`` is replaced; with nothing to learn from, all is ``und``; an empty table stays empty. Very long texts are one sequence
    each, in memory linear in their words times the languages learnt; other texts come in slices that shrink with the languages. Of languages with equal means the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field_ = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, texts in slices(batch, max(1 << 14, BYTES * 16 // max(16, len(field_.languages)))):
                got = field_.label(texts)
                names += got[0]
                scores += got[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(column, labelled(F.col("text").cast("string")))
