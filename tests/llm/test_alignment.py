import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelwright.llm import alignment
from labelwright.llm.tokenize import _byte_alphabet
from conftest import rows as listed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "a", "<|endoftext|> hi <s> </s>", "a▁b", "  two  spaces ", "日本語 text é", "x" * 3000 + " y", "tab\tline\nend", " lead", "trail ", "same same same", "same same same", "don't stop: it's 1,234.5", "é ´ ½ ﬁ"]


@pytest.fixture(scope="module")
def untouched():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(_byte_alphabet())}

    def align(text):
        if not text:
            return [], [], [], []
        a, b, data = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text), (" " + text).encode()
        a_bytes = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            return [], [], [], []
        ends = [np.cumsum([len(x) for x in own]).tolist() for own in (a_bytes, b_bytes)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        return a, b, groups, links

    return align


def test_documents_against_the_untouched_files(spark, untouched, monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab c  é▁\t\n<|endoftext|>日x.,!'s ") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    ids = [None, 7, 7, *range(8, len(texts) + 5)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, block int, links string").repartition(3)
    done = [untouched(t) for t in texts]
    n = Counter(x for r in done for x in r[3])
    most: dict[int, int] = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    want = [(d, len(a), len(b), len(g), len(x), sum(n[y] == most[y[1]] for y in x), sum(n[y] for y in x), ";".join(g)) for d, (a, b, g, x) in zip(ids, done, strict=True)]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert listed(alignment.aligned_documents(df, A, B, shown=True).select(columns)) == sorted(want, key=repr)
    hashed = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want]
    assert listed(alignment.aligned_documents(df, A, B).select(columns)) == sorted(hashed, key=repr)
    names = alignment.link_names(alignment.link_counts(alignment.align(df, A, B)))
    assert {(r.a, r.b): (r.n, r.best) for r in names.collect()} == {x: (k, k == most[x[1]]) for x, k in n.items()}
    assert alignment.aligned_documents(df.limit(0), A, B).count() == 0


def test_stretches_give_the_ids_of_whole_texts():
    own, whole = alignment.SpaceEncoder(B), sentencepiece.SentencePieceProcessor(model_file=B)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé́日 ´½<0x0A>▁\x00\t ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert [x.tolist() for x in own.encode(texts)] == whole.encode(texts)


def test_gallop_and_overlaps_against_search():
    rng = np.random.default_rng(4)
    for _ in range(200):
        total = int(rng.integers(1, 400))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, total), int(rng.integers(0, total)), replace=False)), total) for _ in "ab")
        x, y = alignment.common(a, np.array([0, a.size]), b, np.array([0, b.size]))
        want = np.intersect1d(a, b)
        assert (a[x] == want).all() and (b[y] == want).all() and x.size == want.size
        first, last = alignment.overlaps(a, b)
        begins = np.append(0, a[:-1])
        for i in range(a.size):
            on = [j for j in range(b.size) if (b[j - 1] if j else 0) < a[i] and b[j] > begins[i]]
            assert (first[i], last[i]) == (on[0], on[-1])
