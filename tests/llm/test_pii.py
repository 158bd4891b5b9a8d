import hashlib
import random
import re

from costlens.llm.pii import IBAN_LENGTHS, find_pii, redact


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        total += (v * 2 - (9 if v > 4 else 0)) if i % 2 else v
    return total % 10 == 0


def base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 1, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 2, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 3, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 4, m.end(), "phone"))
    return sorted(out)


def masked(t, spans):
    out, pos = [], 0
    for s in spans:
        if s.start >= pos:
            out += [t[pos : s.start], f"[{s.kind.upper()}]"]
        pos = max(pos, s.end)
    return "".join(out) + t[pos:]


def test_random_texts(spark):
    random.seed(3)
    runs = ["0123456789"] * 3 + [" -.+()@"] * 2 + ["ab_%é😀\n", "1.2.3.4 "]
    words = ["+1 (017) 555-7713", "10.0.0.1", "4111111111111111", "q@w.e", "4111-1111-1111-1111", "256.1.1.1"]
    rows = [(0, None), (1, "")]
    for i in range(2, 900):
        n = random.choice([5, 30, 100])
        bits = (random.choice(random.choice(runs)) if random.random() < 0.9 else random.choice(words) for _ in range(n))
        rows.append((i, "".join(bits)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_pii(df).collect()}
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    for i, t in rows:
        want = base(t or "")
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert found[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), (t, told, found[i].spans)
        for k in ("email", "ip", "card", "phone"):
            assert found[i][f"n_{k}"] == sum(w[3] == k for w in want)
        assert clean[i] == (None if t is None else masked(t, found[i].pii))


def test_added_kinds(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 THE END"),
        (2, "DE88 3704 0044 0532 0130 00"),
        (3, "ssn 123-45-6789"),
        (4, "part 123-45-6789"),
        (5, "write to a.b@c.de"),
    ]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "iban:5:32" and got[2].spans == ""
    assert got[3].spans == "ssn:4:15" and got[4].spans == ""
    assert got[5].spans == "email:9:17" and got[5].pii[0].score == 1.0


def test_context_of_lists_and_words_after(spark):
    many = [f"{100 + i}-45-6789" for i in range(30)]
    rows = [
        (1, "ssn: 123-45-6789, 234-56-7890"),
        (2, "123-45-6789 (SSN)"),
        (3, "ssn " + ", ".join(many)),
        (4, " and ".join(many) + " are social security numbers"),
        (5, "part 123-45-6789, 234-56-7890"),
        (6, "ssn 123-45-6789; " + "of a long way off " * 3 + "234-56-7890"),
        (7, "ssn 123-45-6789, order 5, ssn 234-56-7890"),
        (8, "order 123-45-6789 ssn 234-56-7890"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert got[1] == "ssn: [SSN], [SSN]" and got[2] == "[SSN] (SSN)"
    assert got[3] == "ssn " + ", ".join(["[SSN]"] * 30)
    assert got[4] == " and ".join(["[SSN]"] * 30) + " are social security numbers"
    assert got[5] == rows[4][1] and got[6] == rows[5][1].replace("123-45-6789", "[SSN]")
    assert got[8].endswith(" ssn [SSN]")


def iban(country, rest):
    """An account number with right check digits, in groups of four."""
    code = "".join(str(int(c, 36)) for c in rest + country + "00")
    whole = f"{country}{98 - int(code) % 97:02d}{rest}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def test_accounts_end_where_they_end(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = [(1, f"{de} {gb}"), (2, f"AB12 {de}"), (3, f"FR12 {de} A {gb} THE END"), (4, f"{gb}, {de}, {gb} and {de}")]
    rest = {c: ("1234567890" * 4)[: n - 4] for c, n in IBAN_LENGTHS.items()}
    rows += [(5, " ".join(iban(c, r) for c, r in rest.items())), (6, "DE88 3704 0044 0532 0130 00 DE89")]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "[IBAN] [IBAN]" and got[2] == "AB12 [IBAN]" and got[3] == "FR12 [IBAN] A [IBAN] THE END"
    assert got[4] == "[IBAN], [IBAN], [IBAN] and [IBAN]" and got[6] == rows[5][1]
    found = find_pii(spark.createDataFrame(rows[4:5], "doc_id long, text string")).first()
    assert sum(s.kind == "iban" for s in found.pii) == len(IBAN_LENGTHS)
    assert {"BR", "PK", "RS", "QA", "EG", "KZ", "JO"} <= set(IBAN_LENGTHS)


def test_many_spans_and_long_runs(spark):
    rows = [(1, "10.0.0.1 " * 3000), (2, "a" * 200_000), (3, "1" * 200_000), (4, "+" + ". " * 100_000), (5, "a." * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert got[1].n_ip == 3000 and all(got[i].spans == "" for i in (2, 3, 4, 5))
    assert redact(df.where("doc_id = 1")).first().text == "[IP] " * 3000


def test_rows(odd_rows, no_rows):
    got = find_pii(odd_rows).collect()
    assert len(got) == odd_rows.count() and sum(r.n_email for r in got) == 1
    out = redact(odd_rows)
    assert out.schema.names == odd_rows.schema.names and out.count() == odd_rows.count()
    assert find_pii(no_rows).count() == 0 and redact(no_rows).count() == 0
