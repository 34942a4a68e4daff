"""Suffix-sorted repeats, fill-in-the-middle and the filter audit against plain recomputations, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from memberlens.llm import filter_audit, infill, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, anchor string, part string, n string, spans string"


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", "w") for i, t, lang in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- op11 ----------------------------------------------------------------------------------------------


def _brute_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _repetitive(seed: int) -> list[tuple]:
    r = random.Random(seed)
    letters = ["ab", "abcdefgh", "aé漢 z\n"][seed % 3]
    passages = ["".join(r.choice(letters) for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = []
    for k in range(40):
        text = "".join(r.choice([*passages, "".join(r.choice(letters) for _ in range(r.randint(1, 40)))]) for _ in range(r.randint(0, 5)))
        rows.append((k if k % 7 else None, text, "en"))
    rows += [rows[3], rows[4], (rows[5][0], rows[6][1], "en"), (90, None, None), (91, "", ""), (92, "a" * 400, "en"), (93, "ab" * 300, "en")]
    return rows


@pytest.mark.parametrize("seed, length, sort_bytes", [(1, 12, 1 << 22), (2, 16, 300), (3, 9, 1 << 22), (4, 16, 0), (5, 30, 1000)])
def test_repeats_equal_brute_force(spark, seed, length, sort_bytes):
    rows = _repetitive(seed)
    want = Counter((r[0], *w) for r, w in zip(rows, _brute_repeats([r[1] for r in rows], length), strict=True))
    docs = _frame(spark, rows)
    got = suffix_dedup.digests(docs, length, sort_bytes).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert any(r.n_removed for r in got) and any(not r.n_removed for r in got)


def test_spans_and_kept_bytes(spark, empty):
    rows = _repetitive(6)
    got = suffix_dedup.without_repeats(_frame(spark, rows), 12).collect()
    want = Counter((r[0], w[1], w[2], w[3]) for r, w in zip(rows, _brute_repeats([r[1] for r in rows], 12), strict=True))
    assert want == Counter(
        (r.doc_id, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
    )
    assert all(a.stop < b.start for r in got for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert suffix_dedup.digests(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("direct", [2_000, 8])
def test_two_stage_order_equals_plain_sort(monkeypatch, direct):
    monkeypatch.setattr(suffix_dedup, "DIRECT", direct)
    r = random.Random(direct)
    for k in range(120):
        pieces = [bytes(r.choice(b"ab" if k % 2 else b"abcz") for _ in range(r.randint(12, 90))) for _ in range(r.randint(1, 8))]
        symbols = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
        order = suffix_dedup.suffix_order(symbols, 12)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        # up to the closing symbol; what follows it does not count
        heads = [symbols[i : i + 12].tobytes().split(b"\0")[0] for i in order]
        assert heads == sorted(heads)
        whole = np.array([i for i in order if len(symbols[i : i + 12].tobytes().split(b"\0")[0]) == 12])
        prefixes = suffix_dedup.adjacent_prefixes(symbols, whole, 12)
        for a, b, common in zip(whole, whole[1:], prefixes[1:], strict=False):
            x, y = symbols[a : a + 12].tolist(), symbols[b : b + 12].tolist()
            assert common == next((i for i in range(12) if x[i] != y[i]), 12)


def test_a_long_text_goes_through_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long, "en"), (2, "x" + long[299_000:300_500] + "y", "en"), (3, long[:262_144] + "q" + long[262_145:400_000], "en")]
    want = _brute_repeats([t for _, t, _ in rows], 400)
    got = suffix_dedup.digests(_frame(spark, rows, 1)).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == want


def test_equal_segments_of_a_text_are_one_row(spark):
    r = random.Random(8)
    noise = ["".join(r.choice("abcdefgh ") for _ in range(700)) for _ in range(3)]
    rows = [
        (1, noise[0] + "the pair " * 300 + noise[1], "en"), (2, "the pair " * 200, "en"), (3, noise[1] + "a" * 3_000, "en"),
        (4, noise[2] + noise[2] + "x" + noise[2][:450], "en"), (5, "b" * 401, "en"), (6, "c" * 400, "en"),
    ]
    docs = _frame(spark, rows, 2)
    found = suffix_dedup._occurrences(suffix_dedup._keyed(docs, "doc_id", "text"), 400)
    assert found.groupBy("ka", "anchor", "content").count().where("count > 1").count() == 0
    places = sum(max(0, len(t) - 399) for _, t, _ in rows)
    assert found.selectExpr("sum(times * windows)").first()[0] == places and found.count() < 100
    got = suffix_dedup.digests(docs).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == _brute_repeats([t for _, t, _ in rows], 400)


# -- op12 ----------------------------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", "one line", "a\nb\nc", "a\nb\nc\n", "\n\n\n", "<P>in it\nb", "x\n<S>", "<M>", "é漢\n𝄞𝄞\nz", "a\r\nb\r\n",
    "\n" * 5000, "w" * 200_000, "l\n" * 60_000, "<P\n>", "tail\n\n",
]


def test_units_equal_plain_matching():
    for text in ODD_TEXTS:
        units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
        ends = infill.unit_ends(text or "")
        assert ends == list(np.cumsum([len(u) for u in units]))


def test_fill_in_middle(spark, empty):
    rows = [(k, t, "en") for k, t in enumerate(ODD_TEXTS * 4)] + [(None, "a\nb\nc", "en"), (3, "a\nb\nc", "en"), (3, "a\nb\nc", "en")]
    got = infill.restored(infill.fill_in_middle(_frame(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    forms = Counter()
    for r in got:
        assert r.restored in texts[r.doc_id]
        text = r.restored
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        forms[r.form] += 1
        assert r.n == len(units)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, text)
        else:
            assert (r.prefix_chars, r.middle_chars) == (len(prefix), len(middle))
            assert r.form == ("spm" if h4 % 100 < 50 else "psm")
            psm = f"<P>{prefix}<S>{suffix}<M>{middle}"
            assert r.output == (psm if r.form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
    assert min(forms.values()) > 5 and len(forms) == 3
    untouched = infill.fill_in_middle(_frame(spark, rows), infill.Rule(transformed=0)).select("form").distinct().collect()
    assert [r.form for r in untouched] == ["plain"]
    assert infill.restored(infill.fill_in_middle(empty)).count() == 0


# -- op13 ----------------------------------------------------------------------------------------------


def _brute_audit(rows, labels) -> dict:
    first, good, toxic = {}, set(), set()
    for i, q, t in (x for x in labels if x[0] is not None):
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        judged[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in judged.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[0][letter]]
                left = [d for d in left if not d[0][letter]]
                out[part, order, step] = (
                    len(left), len(gone), sum(d[0][letter] for d in docs) - len(gone),
                    sum(d[0][letter] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                )
    shares = Counter()
    for (part, order, step), values in out.items():
        shares[part, order[step - 1]] += values[1]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, empty):
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(160):
        text = " ".join(r.choice(words[: r.choice([40, 400])]) for _ in range(r.choice([20, 120, 150])))
        text = text.upper() if r.random() < 0.3 else text
        text += r.choice(["", "", " #", "|", "\x0b\x1c z"])
        rows.append((k, text, r.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k][1], "fr") for k in range(0, 60, 3)] + [(5, rows[9][1], "en"), (9, rows[9][1], "en"), (9, rows[9][1], "en")]
    rows += [(None, rows[0][1], "en"), (None, None, None), (-4, "", "de"), (301, None, "de"), (302, "  \t", "de")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (7, None, None), (9, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(_frame(spark, rows), marks).collect()
    want = _brute_audit(rows, labels)
    assert len(got) == len(want) == 5 * 600 - 600
    assert {tuple(g)[:3]: tuple(g)[3:] for g in got} == want
    assert filter_audit.audit(empty, marks).count() == 0
    assert filter_audit.audit(_frame(spark, rows), marks.limit(0)).groupBy().sum("good_lost").first()[0] == 0


def test_positional_counts_and_long_texts():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 1000, 4097):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [(words >> np.uint32(k) & 1).sum() for k in range(32)]
        assert filter_audit.positional_counts(words).tolist() == want
    text = b" ".join(b"%d" % (k % 300_000) for k in range(500_000))
    assert filter_audit._word_counts(text) == (500_000, 300_000)
    assert filter_audit._word_counts(b"x" * (5 << 20)) == (1, 1)
