"""Exact, cached encoding of whole texts with the files of public tokenizers.

The pre-tokenizers of the files used here never join characters across a step from a non-space to a
white-space character, nor across a step from a Latin letter to plain punctuation. A text may therefore
be cut at each such step and its pieces encoded apart. Stretches between spaces repeat (words do), so a task
encodes a stretch once and the rest are lookups. A piece that is one word goes straight to the
tokenizer's model; any other piece takes the tokenizer's whole path. A file's added tokens (end of text
and the like) keep their ids, as the library has it by default.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from labelwright.llm.common import hold

#: The Unicode White_Space characters, as the tokenizers' own patterns see them.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Letters that are one composed character in either case.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Plain punctuation; behind a word it is a piece of its own.
_MARKS = ".,;:!?|"
_PIECE = re.compile(rf"[{_SPACE}]?[{_LETTER}]++(?=[{_SPACE}{_MARKS}]|\Z)|[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")
_WORD = re.compile(rf"[{_SPACE}]?[{_LETTER}]+")
_LETTERS = re.compile(f"[{_LETTER}]+")
#: White space before a space: such a text is not cut at its spaces first.
_LOOSE = re.compile(rf"[{_SPACE}] ")
#: Stretches and pieces that one Python worker keeps (about 120 bytes each), and characters of a text up to which it keeps them (memory stays bounded).
CACHE, LONGEST_KEPT = 1_000_000, 64


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers show for each byte: itself, or one from U+0100 on."""
    shown, spare = [], 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte:
            shown.append(chr(byte))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


class PieceEncoder:
    """Ids of whole texts as uint16 arrays (the vocabularies used are below 65,536 ids).

    What is known lies end to end in one pool of ids, at places: ``words`` has those of words that follow a space, ``others`` those
    of all other pieces and stretches.
    """

    #: Stretches and pieces kept at most.
    kept = CACHE

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids don't fit 16 bits")
        #: A file with a normalizer lower-cases and drops white space; one without keeps a word's space.
        self.folds = self.tokenizer.normalizer is not None
        self.alphabet = dict(enumerate(_byte_alphabet()))
        #: The file's added tokens: found in the raw text before anything else, wherever they stand.
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError(f"{path}: added tokens that depend on what is beside them")
        self.added = {t.content: i for i, t in added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        #: The empty piece is at place 0.
        self.others: dict[str, int] = {"": 0}
        self.pool, self.begins, self.passing = array("H"), array("q", [0, 0]), []

    def _keep(self, kept: dict[str, int], keys: list[str], sizes: np.ndarray) -> None:
        """Gives keys whose ids the pool just got their places."""
        start = len(self.begins) - 1
        self.begins.frombytes((self.begins[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())
        kept.update(zip(keys, range(start, start + len(keys)), strict=True))
        if len(max(keys, key=len, default="")) > LONGEST_KEPT:
            self.passing += [(kept, k) for k in keys if len(k) > LONGEST_KEPT]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of places, end to end, and how many each has."""
        begins = np.frombuffer(self.begins, np.int64)
        first = begins[at]
        own = begins[at + 1] - first
        ends = np.cumsum(own)
        return np.frombuffer(self.pool, np.uint16)[np.repeat(first - (ends - own), own) + np.arange(ends[-1] if ends.size else 0)], own

    def _learn_words(self, kept: dict[str, int], words: list[str], spaced: bool) -> None:
        """New words of letters alone, behind a space or not, by the tokenizer's model."""
        space = "\u0120" if spaced and not self.folds else ""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            asked = [w.lower() for w in part] if self.folds else part
            if not all(map(str.isascii, asked)):
                asked = [w.encode().decode("latin-1").translate(self.alphabet) for w in asked]
            found = [[t.id for t in got] for got in map(self.tokenizer.model.tokenize, [space + w for w in asked] if space else asked)]
            self.pool.extend(chain.from_iterable(found))
            self._keep(kept, part, np.fromiter(map(len, found), np.int64, len(found)))

    def _learn(self, new: list[str]) -> None:
        """Gives each new text its place: from its pieces, if it has several. Texts behind a space begin with it."""
        words, whole, cut = {}, {}, []
        for text in new:
            pieces = _PIECE.findall(text)
            if not self.folds:  # such a file joins a word with a space only, with no other white space
                pieces = [x for p in pieces for x in ((p[0], p[1:]) if p[0] != " " and not p[0].isalpha() and _WORD.fullmatch(p) else (p,))]
            if len(pieces) > 1:
                cut.append((text, pieces))
            for piece in pieces:
                if piece not in self.others:
                    (words if piece[0].isalpha() and _WORD.fullmatch(piece) else whole)[piece] = None
        self._learn_words(self.others, list(words), False)
        whole = list(whole)
        for at in range(0, len(whole), 4096):
            got = [x.ids for x in self.tokenizer.encode_batch(whole[at : at + 4096], add_special_tokens=False)]
            self.pool.extend(chain.from_iterable(got))
            self._keep(self.others, whole[at : at + 4096], np.fromiter(map(len, got), np.int64, len(got)))
        if cut:
            counts = np.fromiter((len(own) for _, own in cut), np.int64, len(cut))
            ids, own = self._gather(np.fromiter((self.others[p] for _, pieces in cut for p in pieces), np.int64, counts.sum()))
            self.pool.frombytes(ids.tobytes())
            self._keep(self.others, [t for t, _ in cut], np.add.reduceat(own, np.cumsum(counts) - counts))

    def _shrink(self, recent: list[str]) -> None:
        """Forgets long texts; and, with too many kept, all but the words met last."""
        for kept, key in self.passing:
            kept.pop(key, None)
        self.passing = []
        if len(self.begins) > self.kept or len(self.pool) > 8 * self.kept:
            recent = list({x for x in recent[: self.kept // 2] if x in self.words})
            ids, own = self._gather(np.fromiter(map(self.words.__getitem__, recent), np.int64, len(recent)))
            self.clear()
            self.pool.frombytes(ids.tobytes())
            self._keep(self.words, recent, own)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Added tokens are cut out first; what stands between them is encoded as texts of their own."""
        texts = [t or "" for t in texts]
        odd = {i: self.cut.split(t) for i, t in enumerate(texts) if self.cut and any(x in t for x in self.added)}
        if not odd:
            return self._encode(texts)
        parts = [x for i, t in enumerate(texts) for x in (odd[i][::2] if i in odd else (t,))]
        got = iter(self._encode(parts))
        out = []
        for i in range(len(texts)):
            own = [next(got)]
            for name in odd.get(i, ())[1::2]:
                own += [np.array([self.added[name]], np.uint16), next(got)]
            out.append(np.concatenate(own))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Cut at single spaces, number the different stretches, look each up (a word, and the marks behind it) or learn it, and gather."""
        tight = [not _LOOSE.search(t) for t in texts]
        lists = pc.split_pattern(pa.array([t if k else "" for t, k in zip(texts, tight, strict=True)], pa.string()), " ")
        codes = lists.flatten().dictionary_encode()
        different = codes.dictionary
        stems = pc.ascii_rtrim(different, characters=_MARKS)
        marked = np.flatnonzero(pc.binary_length(different).to_numpy() > pc.binary_length(stems).to_numpy())
        marks = [x[len(x.rstrip(_MARKS)) :] for x in different.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist()]
        stems = stems.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.words.get, stems, repeat(-1)), np.int64, len(stems))
        new = np.flatnonzero(place < 0)
        is_word = np.fromiter((_LETTERS.fullmatch(stems[i]) is not None for i in new.tolist()), bool, new.size)
        self._learn_words(self.words, list(dict.fromkeys(stems[i] for i in new[is_word].tolist())), True)
        place[new[is_word]] = [self.words[stems[i]] for i in new[is_word].tolist()]
        # A text's first stretch has no space before it; texts not cut at spaces stand whole in its place.
        firsts = [t.partition(" ")[0] if k else t for t, k in zip(texts, tight, strict=True)]
        odd = new[~is_word]
        whole = [" " + x for x in different.take(pa.array(odd)).to_numpy(zero_copy_only=False).tolist()]
        self._learn([x for x in dict.fromkeys(chain(marks, whole, firsts)) if x not in self.others])
        place[odd] = [self.others[x] for x in whole]
        behind = np.zeros(place.size, np.int64)
        behind[marked] = [self.others[x] for x in marks]
        behind[odd] = 0
        index = codes.indices.to_numpy()
        at = np.column_stack([place[index], behind[index]])
        heads = lists.offsets.to_numpy()[:-1]
        at[heads, 0], at[heads, 1] = [self.others[x] for x in firsts], 0
        ids, own = self._gather(at.ravel())
        cuts = np.append(0, np.cumsum(own)[1::2])[np.append(heads, len(at))].tolist()
        self._shrink(stems)
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str, kept: int) -> PieceEncoder:
    made = PieceEncoder(path)
    made.kept = kept
    return made


def encoder(path: str, kept: int | None = None) -> PieceEncoder:
    """The encoder of a file, one for each Python worker, with its cache of ``kept`` stretches (``PieceEncoder.kept`` if none is named)."""
    kept = kept or PieceEncoder.kept
    hold(f"tokens {path} {kept}", _encoder.cache_clear)
    return _encoder(path, kept)
