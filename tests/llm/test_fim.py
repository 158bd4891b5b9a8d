import hashlib
import random
import re

import pytest

import costlens.llm.fim as M
from costlens.llm.queries import QUERIES

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(text, key):
    """The contract by the pattern and plain slicing."""
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    n = len(units)
    told = hashlib.sha256(b"7:" + ("" if key is None else str(key)).encode()).hexdigest()
    h = [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    random.seed(n)
    widths = [random.randrange(1, 90) for _ in range(n)]
    units = M.SkipList(widths)
    assert len(units.lanes) >= (1 if n < 50 else 3)
    for lane, (steps, points, _) in enumerate(units.lanes):  # a lane covers what the one below does, up to its last node
        assert sum(steps) <= n and (lane or sum(steps) == n and sum(points) == sum(widths))
    for rank in {0, n, n // 2, n // 3, *(random.randrange(n + 1) for _ in range(40))}:
        assert units.locate(rank) == sum(widths[:rank])


def test_few_steps_reach_a_rank():
    units = M.SkipList([1] * 50_000)
    steps = 0

    class Seen(type(units.lanes[0][0])):
        def __getitem__(self, i):
            nonlocal steps
            steps += 1
            return super().__getitem__(i)

    units.lanes = [(Seen("q", a), b, c) for a, b, c in units.lanes]
    assert units.locate(49_999) == 49_999 and steps < 250


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "a", "a\n", "\na", "a\n\nb", "日本\nü\r\n x\n", "x<M>y\nz", "\U0001f600\n" * 9])
def test_units_and_round_trip(text):
    assert M.unit_widths(text) == [len(u) for u in UNIT.findall(text)]
    for key in (None, *range(40)):
        got = M.transform(text, key)
        assert got == brute(text, key)
        assert M.restore(got[4], got[1]) == text


def test_shares():
    forms = [M.transform("a\nb\nc\n", k, fim_percent=60, spm_percent=25)[1] for k in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.4) < 0.03 and abs(forms.count("spm") / 4000 - 0.15) < 0.03


def test_rows(spark, odd_rows, no_rows):
    got = M.fill_in_middle(odd_rows).collect()
    rows = odd_rows.collect()
    want = sorted((r.doc_id or 0, *brute(r.text, r.doc_id), r.text or "") for r in rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id or 0, *r[1:]) for r in got), key=key) == sorted(want, key=key)
    assert M.fill_in_middle(no_rows).count() == 0


def test_query_equals_the_rule_on_whole_texts(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_fim"](spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        n, form, p, m, out = brute(r.text, r.doc_id)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
