"""Cross-tokenizer alignment against both libraries on whole texts and a plain walk over byte ends."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from chronoweave.llm import alignment
from chronoweave.llm.queries import tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), public_tokenizers.PATTERN
ODD = [
    "two  blanks", " leads", "trails ", "\n\nlines\n \n\ttabs\r\n", "<|endoftext|> <s> <unk> <0x41>", "a b  c", "▁already", "a ▁ b",
    "naïvé İş 漢字 \U0001f600‍\U0001f525 it's they'LL 12345 ...!? \x00\x01 \x1c x", "x" * 5000 + " y", "́ mark ́first", " ", "\n",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(libraries, texts):
    """(n_a, n_b, groups, links) of each text, from whole texts."""
    first, second = libraries
    alphabet, out = alignment.byte_alphabet(), []
    for text in texts:
        ids, others = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a = [bytes(map(alphabet.__getitem__, first.id_to_token(i))) for i in ids]
        b = [bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in others]
        if not text or not b"".join(a) == b"".join(b) == b" " + text.encode():
            out.append((0, 0, "", []))
            continue
        i = j = x = y = 0
        links, groups, own = [], [], ([], [])
        x, y = len(a[0]), len(b[0])
        own = ([ids[0]], [others[0]])
        while True:
            links.append((ids[i], others[j]))
            if x == y:
                groups.append("|".join(",".join(map(str, side)) for side in own))
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                own = ([ids[i]], [others[j]])
                x, y = x + len(a[i]), y + len(b[j])
            elif x < y:
                i += 1
                x += len(a[i])
                own[0].append(ids[i])
            else:
                j += 1
                y += len(b[j])
                own[1].append(others[j])
        out.append((len(a), len(b), ";".join(groups), links))
    return out


@pytest.mark.parametrize("lane", [2, 512])
def test_aligns_as_whole_texts(libraries, docs, lane, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", lane)
    texts = [x.text for x in docs.select("text").collect()] + ODD
    made = alignment.align_texts(alignment.Tokens(*FILES, remembered=50), texts)
    for k, (n_a, n_b, groups, links) in enumerate(brute(libraries, texts)):
        assert (made["n_a"][k], made["n_b"][k], made["groups"][k]) == (n_a, n_b, groups), texts[k]
        assert (made["n_groups"][k], made["n_links"][k]) == (groups.count(";") + 1 if groups else 0, len(links))
        pairs = Counter(a * 32000 + b for a, b in links)
        assert dict(zip(np.frombuffer(made["pairs"][k], np.int64).tolist(), np.frombuffer(made["counts"][k], np.int32).tolist(), strict=True)) == pairs


@pytest.mark.parametrize("block", [300, 10**6])
def test_corpus_counts(spark, libraries, docs, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 1000)
    some = docs.where("doc_id < 60 or doc_id is null or doc_id > 90000").select("doc_id", "text", "label")
    some = some.unionByName(spark.createDataFrame([(91000 + k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, label string"))
    rows = [(x.doc_id, x.text) for x in some.collect()]
    want, total = brute(libraries, [t for _, t in rows]), Counter()
    for *_, links in want:
        total.update(links)
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    expected = Counter(
        (i, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for (i, _), (n_a, n_b, g, links) in zip(rows, want, strict=True)
    )
    found = alignment.alignment_counts(some, *FILES)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(x) for x in found.select(*columns).collect()) == expected


def test_changed_and_long_texts(libraries):
    tokens = alignment.Tokens(*FILES)
    long = "".join(np.random.default_rng(1).choice(list("abc \né.,"), 2_000_000).tolist())
    made = alignment.align_texts(tokens, [None, "", "▁", long])
    assert made["groups"][:3] == ["", "", ""] and made["n_links"][:3].tolist() == [0, 0, 0]
    n_a, n_b, groups, links = brute(libraries, [long])[0]
    assert (made["n_a"][3], made["n_b"][3], made["n_links"][3], made["groups"][3]) == (n_a, n_b, len(links), groups)


def test_empty_table(docs):
    assert alignment.alignment_counts(docs.limit(0), *FILES).count() == 0
