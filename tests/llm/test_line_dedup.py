"""Fuzzy line dedup against all pairs of lines, by length, by ids and by place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import line_dedup
from chronoweave.llm.edits import within
from chronoweave.llm.line_dedup import edit_distance, normalise, similar

SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def word(rng):
    return "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))


def test_distances():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = "".join(rng.choice(list("abc"), rng.integers(1, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 8)):
            b.insert(rng.integers(0, len(b) + 1), "d") if rng.random() < 0.5 else b.pop(rng.integers(0, len(b))) if len(b) > 1 else None
        b = "".join(b)
        rows = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(rows[j] + (x != y), rows[j + 1] + 1, new[j] + 1))
            rows = new
        assert edit_distance(a, b) == rows[-1]
        for most in (1, 4, 20):
            found = line_dedup.banded_distance(a, b, most)
            assert found == rows[-1] if rows[-1] <= most else found > most


def test_long_lines():
    rng = np.random.default_rng(2)
    words = [word(rng) for _ in range(30_000)]
    a, b = " ".join(words), " ".join(rng.permutation(words))
    assert not similar(a, b) and not line_dedup.Line(a).similar(line_dedup.Line(b), 0.9)
    changed = list(words)
    for k in rng.integers(0, len(words), 700):
        changed[k] = word(rng)
    assert similar(a, " ".join(changed)) and line_dedup.Line(a).similar(line_dedup.Line(" ".join(changed)), 0.9)


def test_short_lines_share_a_segment_key():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        a = list("".join(rng.choice(list("abcde "), rng.integers(10, 59))))
        b = list(a)
        for _ in range(rng.integers(1, len(a) // 10 + 1)):
            k, kind = rng.integers(0, len(b)), rng.integers(0, 3)
            if kind == 0:
                b[k] = "z"
            elif kind == 1:
                b.insert(k, "z")
            else:
                b.pop(k)
        a, b = normalise("".join(a)), normalise("".join(b))
        if max(len(a), len(b)) < line_dedup.SHORT and similar(a, b):
            assert line_dedup.segment_keys(a) & line_dedup.segment_keys(b), (a, b)


def brute(rows):
    """Kept lines by the group of all pairs; rows are (place, text) in the order of places."""
    occurrences = [(place, number, normalise(line)) for place, text in rows for number, line in enumerate((text or "").split("\n")) if normalise(line)]
    names = sorted({x[2] for x in occurrences})
    root = {x: x for x in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if similar(a, b):
                root[top(a)] = top(b)
    stays = {}
    for place, number, line in occurrences:
        stays.setdefault(top(line), (place, number))
    gone = {(place, number) for place, number, line in occurrences if stays[top(line)] != (place, number)}
    return [None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (place, k) not in gone) for place, text in rows]


def typo(rng, line):
    k = rng.integers(0, len(line))
    return line[:k] + "q" + line[k + int(rng.integers(0, 2)) :]


def some_lines(rng, count):
    out = []
    for words in (1, 2, 3, 4, 5, 7, 10, 15, 40, 90, 150):
        for _ in range(count):
            own = " ".join(word(rng) for _ in range(words)) + (" ending here" if words < 3 else "")
            out += [own, typo(rng, own), " ".join(word(rng) for _ in range(words))]
    return out


@pytest.mark.parametrize("ids", ["distinct", "null", "same"])
def test_keeps_one_of_each_group_whatever_the_ids(spark, ids):
    rng = np.random.default_rng(4)
    lines = [*some_lines(rng, 4), *["Again and\tagain this line"] * 5, "", "  ", "\n\n"]
    texts = [lines[k] + "\n\n" + lines[(k * 7) % len(lines)] for k in rng.permutation(len(lines))] + [None, ""]
    texts += texts[:4]
    number = {"distinct": lambda k: k, "null": lambda k: None, "same": lambda k: 7}[ids]
    rows = [(number(k), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("x") for c in ("file", "idx", "line", "doc", "lost")})
    found = line_dedup.dedup_lines(df).collect()
    want = brute(list(enumerate(texts)))
    assert sorted(str(x.text) for x in found) == sorted(map(str, want))
    kept = sum(len([line for line in (t or "").split("\n") if normalise(line)]) for t in want)
    assert sum(x.lines - x.dropped for x in found) >= kept and all(x.file == "x" for x in found)


def test_recall_by_words(spark):
    """A typo anywhere, in lines of one word and more."""
    rng = np.random.default_rng(5)
    for words in (1, 2, 3, 4, 5, 6, 7, 12, 25, 60, 120):
        pairs = []
        for _ in range(60):
            own = " ".join(word(rng) + "al" for _ in range(words))
            own = own if len(own) >= 10 else own + "x" * (10 - len(own))
            changed = typo(rng, own)
            if words >= 12:
                changed = " ".join(word(rng) if k % 16 == 9 else w for k, w in enumerate(changed.split(" ")))
            if similar(own, changed):
                pairs.append((own, changed))
        hashes = lambda x: line_dedup.line_keys([x], *line_dedup.word_hashes(x.encode()))[1].tolist()
        assert len(pairs) >= 20 and np.mean([bool(set(hashes(a)) & set(hashes(b))) for a, b in pairs]) >= 0.9


def test_null_ids_take_linear_time(spark):
    texts = [f"row {k} has its own words {k * k} {k * 7919}\nand all share this line of text" for k in range(5000)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(8)
    done = line_dedup.dedup_lines(df).agg(F.sum("dropped"), F.count("*")).first()
    assert done[1] == 5000 and done[0] >= 4999


@pytest.mark.parametrize("chunk", [8, 1024])
def test_large_buckets(spark, chunk, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    rng = np.random.default_rng(6)
    base, lines = [word(rng) for _ in range(40)], []
    for _ in range(60):  # a family that drifts away from its first member
        base[rng.integers(0, 40)] = word(rng)
        lines.append(" ".join(base))
    lines += [" ".join([*base[:20], *(word(rng) for _ in range(20))]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1)
    found = sorted(str(x.text) for x in line_dedup.dedup_lines(df).collect())
    assert found == sorted(map(str, brute(list(enumerate(lines)))))


def test_counts_tell_no_similar_lines_apart():
    """Counts of letters and of pairs bound the edits from below, and tell most lines with a common block apart."""
    rng = np.random.default_rng(7)
    told = []
    for words in (5, 9, 12, 40, 90):
        for _ in range(150):
            own = " ".join(word(rng) for _ in range(words))
            changed = own
            for _ in range(rng.integers(1, len(own) // 10 + 1)):
                changed = typo(rng, changed)
            other = " ".join([*own.split(" ")[: words // 4], *(word(rng) for _ in range(words - words // 4))])
            for a, b in ((own, changed), (own, other)):
                a, b = normalise(a), normalise(b)
                edits, sketch = edit_distance(a, b), line_dedup.letter_counts([a, b]).view(np.uint64)
                apart = int(line_dedup.letters_apart(sketch[:1], sketch[1:])[0])
                assert apart <= 2 * edits - abs(len(a) - len(b)) and line_dedup.pairs_apart(a, b) <= edits
            if words in (9, 12):
                told.append(apart > 2 * int(0.1 * max(len(a), len(b)) + 1e-9) - abs(len(a) - len(b)))
    assert np.mean(told) >= 0.9


def test_common_blocks_make_few_pairs():
    """Lines of one bucket that share a block and little else."""
    rng = np.random.default_rng(8)
    plain = [" ".join(["so it is said that", *(word(rng) for _ in range(8))]) for _ in range(300)]
    hashes, first = line_dedup.word_hashes("\n".join(plain).encode())
    sizes, lines = np.array([len(x) for x in plain], np.int32), np.arange(300)
    fp = line_dedup.fingerprints(hashes, first)
    columns = {"key": 0 * lines, "piece": 0 * lines, "line": lines, "component": lines, "size": sizes, "fp": fp, "side": 0 * lines, "letters": line_dedup.letter_counts(plain)}
    batch = line_dedup.pa.RecordBatch.from_pydict({k: line_dedup.pa.array(x) for k, x in columns.items()})
    made = sum(x.num_rows for x in line_dedup._near_pairs(0.9)(iter([batch])))
    near = np.triu(np.bitwise_count((fp[:, None] ^ fp).view(np.uint64)) <= line_dedup.FEW_WORDS_NEAR, 1).sum()
    assert near > 1000 and made < near / 10


def test_many_distances_at_once():
    rng = np.random.default_rng(9)
    for size, letters in ((12, "ab"), (70, "abcd"), (400, "abcé "), (1000, "abc文😀")):
        first, second = [], []
        for _ in range(150):
            a = "".join(rng.choice(list(letters), rng.integers(0, size)))
            b = list(a)
            for _ in range(rng.integers(0, size // 5 + 1)):
                k = int(rng.integers(0, len(b) + 1))
                b[k : k + int(rng.integers(0, 2))] = [str(rng.choice(list(letters)))] * int(rng.integers(0, 2))
            first.append(a)
            second.append("".join(b))
        allowed = rng.integers(0, size // 4 + 1, len(first))
        want = [edit_distance(a, b) <= x for a, b, x in zip(first, second, allowed, strict=True)]
        assert within(first, second, allowed).tolist() == want and 10 < sum(want) < 150


def test_near_copies_make_few_rows():
    """A bucket of near copies gives a link a line, and each pair is compared in one of the buckets it shares."""
    rng = np.random.default_rng(10)
    words = [word(rng) for _ in range(40)]
    plain = [" ".join([word(rng) if k in rng.integers(0, 40, 2) else w for k, w in enumerate(words)]) for _ in range(300)]
    hashes, first = line_dedup.word_hashes("\n".join(plain).encode())
    lines = np.arange(300)
    one = {"piece": 0 * lines, "side": 0 * lines, "line": lines, "component": lines, "size": np.array([len(x) for x in plain]), "fp": line_dedup.fingerprints(hashes, first)}
    one |= {"letters": line_dedup.letter_counts(plain), "plain": plain, "keys": [[3, 8]] * 300}
    both = [line_dedup.pa.RecordBatch.from_pydict({"key": np.full(300, key)} | one) for key in (3, 8)]
    active = sum(x.num_rows for x in line_dedup._partnered(0.9)(iter(both)))
    made = [x.to_pydict() for x in line_dedup._linked(0.9)(iter(both))]
    assert active <= 600 and sum(len(x["a"]) for x in made) < 300
    links = [(a, b) for x in made for a, b in zip(x["a"], x["b"], strict=True)]
    root = line_dedup._roots(lines, *np.array(links).T)
    pairs = np.array([(i, j) for i in range(300) for j in range(i) if similar(plain[i], plain[j])])
    assert len(pairs) > 3000 and np.array_equal(root[pairs[:, 0]], root[pairs[:, 1]])
