from __future__ import annotations

import base64
import hashlib
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillgraph.llm import pii, secrets
from quillgraph.llm.tokens import encoding

from .fixtures import awkward, frame, prose

ENC = encoding()


def keys():
    r = random.Random(11)
    raw = lambda n: bytes(r.randrange(256) for _ in range(n))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return ["AKIA" + "".join(r.choice(chars[:26] + chars[52:]) for _ in range(16)), "ghp_" + "".join(r.choice(chars) for _ in range(36)), base64.b64encode(raw(30)).decode(), base64.b64encode(raw(64)).decode(), "".join(r.choice(chars) for _ in range(24))]


def clean():
    return [
        hashlib.md5(b"x").hexdigest(), hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest(), hashlib.sha512(b"x").hexdigest().upper(), str(uuid.UUID(int=12345678901234567890)),
        "2024-05-17T10:11:12.123Z", "1234-5678-9012-3456", "https://example.com/a8Zk39dkQ0s8dKdl3", "someone1234567890x@example.com", "255.255.255.255", "internationalisation2024", "chapter_12_introduction_to_graphs",
    ]


def test_random_strings_are_found_where_they_are(spark):
    rows = [(i, f"é {prose(9, i)} key={k}, {prose(5, i)}") for i, k in enumerate(keys())]
    got = {r.doc_id: rows[r.doc_id][1][r.start : r.end] for r in secrets.scan(frame(spark, rows)).collect()}
    assert got == {i: k for i, k in enumerate(keys())}


def test_known_identifiers_are_left_alone(spark):
    rows = [(i, f"see {c} here") for i, c in enumerate(clean())]
    assert secrets.scan(frame(spark, rows)).collect() == []


def test_scan_equals_a_plain_loop(spark):
    rows = awkward() + [(100 + i, f"{k} and {c}\n{k}") for i, (k, c) in enumerate(zip(keys(), clean(), strict=False))]
    expected = []
    for i, t in rows:
        at = 0
        for w in __import__("re").findall(r"[^\t-\r ]+|[\t-\r ]+", t or ""):
            if not w.isspace() and len(w.encode()) >= secrets.LEAST and any("0" <= c <= "9" for c in w):
                expected += [(i, at + a, at + b, n, x) for a, b, n, x in secrets.finds(w, ENC)]
            at += len(w)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in secrets.scan(frame(spark, rows)).collect()), key=key) == sorted(expected, key=key)
    assert len(expected) >= 10


def test_secrets_beside_addresses_and_links(spark):
    key, token = keys()[0], keys()[1]
    plain = "qWzXvKpLrTnMbGhJdFsY"  # mixed case without a digit
    cases = [
        (f'{{"url":"https://x.io/v1","api_key":"{key}"}}', [key]), (f"postgres://app:{keys()[4]}@db:5432", [keys()[4]]), (f"postgres://app:{keys()[4]}@db.example.com:5432/main", [keys()[4]]),
        (f"https://h.io/?token={token}", [token]), (f"www.h.io/a?x=1&token={token}", [token]), (f"mail=someone1234567890x@example.com;key={key}", [key]), (f"key={plain}", [plain]),
        ("https://example.com/a8Zk39dkQ0s8dKdl3?page=2", []), ("www.example.com/a8Zk39dkQ0s8dKdl3", []), ("getElementsByTagNameNS", []), ("InternationalisationAndLocalisation", []),
    ]
    rows = [(i, f"é see {t} here") for i, (t, _) in enumerate(cases)]
    got = {i: [] for i, _ in rows}
    for r in secrets.scan(frame(spark, rows)).collect():
        got[r.doc_id].append(rows[r.doc_id][1][r.start : r.end])
    assert got == {i: found for i, (_, found) in enumerate(cases)}


def test_digests_and_keys_of_their_length(spark):
    h = hashlib.sha1(b"seed").hexdigest()
    found = [f'token = "{h}"', f"api_key={h}", f"password: '{h}'", f"secret {h}", f"the token is {h}", f'{{"key":"{h}"}}', f"https://h.io/?token={h}"]
    not_found = [f"commit {h}", f'"commit": "{h}"', f"sha1:{h}", f"sha1 = {h}", f"etag: {h}", f"checksum={h}", f"see {h} there", f"revision={h}", f"sha512-{'aB3' * 20}"]
    rows = [(i, t) for i, t in enumerate(found + not_found)]
    got = {r.doc_id: rows[r.doc_id][1][r.start : r.end] for r in secrets.scan(frame(spark, rows)).collect()}
    assert got == {i: h for i in range(len(found))}
    assert secrets.scan(frame(spark, rows), known=frozenset([h])).count() == 0


def _independent(text):
    """Key runs under 2.5 characters a token, by another route: single characters, the library's tokens, plain rules."""
    import base64 as b64

    import tiktoken

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {b64.b64decode(x.split()[0]): int(x.split()[1]) for x in lines}
    enc = tiktoken.Encoding("other", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in key:
            j += 1
        if j - i >= 16:
            bare, end = text[i:j], j
            while end < len(text) and end < j + 2 and text[end] == "=":
                end += 1
            kinds = sum(any(f(c) for c in bare) for f in (str.isdigit, str.islower, str.isupper))
            turns = sum(a.islower() != b.islower() for a, b in zip(bare, bare[1:], strict=False) if a.isalpha() and b.isalpha())
            hexed = len(bare) in (32, 40, 56, 64, 96, 128) and all(c in "0123456789abcdef" for c in bare)
            assigned = text[:i].rstrip()[-1:] in ("=", ":", '"') and "commit" not in text[max(0, i - 20) : i]
            if kinds >= 2 and (any(c.isdigit() for c in bare) or 4 * turns >= len(bare)) and (not hexed or assigned):
                n = len(enc.encode_ordinary(text[i:end]))
                if (end - i) / n < 2.5:
                    out.append((i, end, n, round((end - i) / n, 4)))
            j = end
        i = max(j, i + 1)
    return out


def test_scan_equals_an_independent_rule(spark):
    r = random.Random(5)
    h = hashlib.sha1(b"seed").hexdigest()
    parts = [*keys(), f'token = "{h}"', f"commit {h}", h, "internationalisation2024", "chapter_12_introduction_to_graphs", "plain", "qWzXvKpLrTnMbGhJdFsY", "AAAA" * 5, "snake_case_of_words"]
    rows = [(i, " ".join(r.choice([prose(r.randint(1, 6), i * 9 + k), r.choice(parts)]) for k in range(12))) for i in range(60)]
    expected = sorted((i, *f) for i, t in rows for f in _independent(t))
    assert sorted(tuple(x) for x in secrets.scan(frame(spark, rows)).collect()) == expected
    assert len(expected) > 60


def test_planted_tokens_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    import re

    planted = {(r.doc_id, m.start(1), m.end(1)) for r in docs.where("text LIKE '%token = %'").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    found = {(r.doc_id, r.start, r.end) for r in secrets.scan(docs).collect()}
    assert len(planted) > 5 and len(planted & found) >= 0.95 * len(planted) and len(found) <= 1.2 * len(planted)


def test_long_words_take_linear_time():
    for sign in ("a1", "://", "@", "a@b.co,", "www.", "https://x/"):
        secrets.finds(sign * (100_000 // len(sign)), ENC)


def test_empty(spark):
    assert secrets.scan(frame(spark, [])).collect() == [] == pii.find(frame(spark, [])).collect()
    assert pii.redacted(frame(spark, [])).collect() == []


FOUND = [
    ("write to jane.doe@example.co.uk now", "email", "jane.doe@example.co.uk"), ("call +1 (555) 123-4567 today", "phone", "+1 (555) 123-4567"), ("tel 555-123-4567.", "phone", "555-123-4567"),
    ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"), ("IBAN DE89 3704 0044 0532 0130 00 bank", "iban", "DE89 3704 0044 0532 0130 00"), ("ssn 123-45-6789", "ssn", "123-45-6789"), ("server 192.168.10.1 is up", "ip", "192.168.10.1"),
]
NOT = ["card 4111 1111 1111 1112 ok", "IBAN DE89 3704 0044 0532 0130 01", "version 1.2.3.4 of it", "999.1.1.1", "ssn 000-45-6789", "a@b", "@handle", "12345", "isbn 978-3-16", "serial 123-45-6789"]


@pytest.mark.parametrize(("text", "kind", "span"), FOUND)
def test_found(text, kind, span):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [(kind, span)]


@pytest.mark.parametrize("text", NOT)
def test_not_found(text):
    assert pii.spans(text) == []


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("card 4111 1111 1111 1111 12/25", "4111 1111 1111 1111"), ("4111111111111111 123", "4111111111111111"), ("12 4111 1111 1111 1111", "4111 1111 1111 1111"),
        ("no.4111111111111111", "4111111111111111"), ("4111-1111-1111-1111 2025 123", "4111-1111-1111-1111"), ("77 378282246310005 1234", "378282246310005"),
    ],
)
def test_cards_beside_other_numbers(text, span):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [("card", span)]


def test_two_cards_in_a_run():
    text = "4111 1111 1111 1111 5500 0000 0000 0004"
    assert [text[a:b] for _, a, b, _ in pii.spans(text)] == [text[:19], text[20:]]
    assert pii.spans("1.4111111111111111") == []


def test_words_on_both_sides_and_one_kind_of_digits(spark):
    score = lambda t: pii.spans(t, 0.0)[0][3]
    assert score("4111 1111 1111 1111 is my card") == score("my card is 4111 1111 1111 1111") > score("see 4111 1111 1111 1111 there")
    arabic = "phone +\u0664\u0664 \u0662\u0660\u0667\u0669 \u0664\u0666\u0660\u0669 \u0665\u0668"
    assert pii.spans(arabic) == [] == pii.spans(arabic + " 7")
    assert pii.find(frame(spark, [(1, arabic), (2, arabic + " 7")])).collect() == []


def test_spans_put_there_are_the_spans_found(spark):
    """An oracle by construction: values made with checksums computed here, between words that no pattern meets."""
    r = random.Random(3)

    def card():
        d = [4] + [r.randrange(10) for _ in range(14)]
        total = sum(sum(divmod(2 * x, 10)) if k % 2 == 0 else x for k, x in enumerate(d))
        d.append(-total % 10)
        return "".join(map(str, d))

    def iban():
        body = "".join(str(r.randrange(10)) for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    make = {
        "email": lambda: f"u{r.randrange(999)}.x@mail{r.randrange(99)}.example.org", "ip": lambda: ".".join(str(r.randrange(1, 256)) for _ in range(4)), "phone": lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
        "card": card, "iban": iban, "ssn": lambda: f"{r.randrange(100, 665)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
    }
    base = {"email": 0.9, "ip": 0.7, "phone": 0.7, "card": 0.8, "iban": 0.9, "ssn": 0.6}
    cue = {"email": "contact", "ip": "host", "phone": "fax", "card": "visa", "iban": "bank", "ssn": "social"}
    wrong = [str(int(card()[:-1] + "0") + 1 + (int(card()[-1]) == 1)) for _ in range(5)]
    wrong = [w for w in wrong if not pii.luhn(w)]
    rows, expected = [], []
    for i in range(60):
        text = "\u00e9 \U0001f642 "
        for _ in range(r.randrange(1, 9)):
            kind = r.choice(list(make))
            filler = lambda: " ".join("".join(r.choice("bdgjk") for _ in range(6)) for _ in range(9)) + " "
            named = r.random() < 0.5
            text += filler() + (cue[kind] + " " if named else "")
            value = make[kind]()
            expected.append((i, kind, len(text), len(text) + len(value), round(min(1.0, base[kind] + 0.1 * named), 2)))
            text += value + " " + filler() + r.choice(wrong) + " " if wrong else value + " "
        rows.append((i, text))
    assert sorted(tuple(x) for x in pii.find(frame(spark, rows)).collect()) == sorted(expected)


def test_overlaps_are_settled_as_by_comparing_all():
    r = random.Random(8)
    for _ in range(300):
        group = []
        for _ in range(r.randrange(2, 12)):
            a = r.randrange(30)
            group.append((r.choice("xyz"), a, a + r.randrange(1, 9), r.choice((0.5, 0.7, 0.9))))
        plain = []
        for s in sorted(group, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
            if all(s[2] <= t[1] or t[2] <= s[1] for t in plain):
                plain.append(s)
        assert pii._settled(group) == sorted(plain, key=lambda s: s[1])


def test_many_spans_take_linear_time():
    import time

    text = "a.b@example.com 4111111111111111 " * 40_000
    began = time.process_time()
    assert len(pii.spans(text)) == 80_000
    assert time.process_time() - began < 30


def test_words_nearby_move_the_score():
    score = lambda t: pii.spans(t, 0.0)[0][3]
    assert score("ssn 123-45-6789") > score("see 123-45-6789") > score("part 123-45-6789")


@given(st.integers(0, 10**15))
@settings(max_examples=80)
def test_checksums_catch_any_single_digit(n):
    body = f"{n:015d}"
    good = next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))
    for k in range(16):
        assert not pii.luhn(good[:k] + str((int(good[k]) + 1) % 10) + good[k + 1 :])
    iban = next(f"DE{c:02d}{n:018d}" for c in range(100) if pii.mod97(f"DE{c:02d}{n:018d}"))
    for k in range(4, 22):
        assert not pii.mod97(iban[:k] + str((int(iban[k]) + 1) % 10) + iban[k + 1 :])


def test_find_and_redact_all_rows(spark):
    rows = awkward() + [(100 + i, f"{prose(60, i)}\n🙂 {t} {prose(3, i)}") for i, (t, *_) in enumerate(FOUND)] + [(200, FOUND[0][0]), (200, FOUND[0][0]), (None, FOUND[1][0])]
    docs = frame(spark, rows)
    expected = [(i, *s) for i, t in rows for s in pii.spans(t)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in pii.find(docs).collect()), key=key) == sorted(expected, key=key)
    out = pii.redacted(docs)
    assert out.columns == docs.columns

    def hidden(t):
        for kind, a, b, _ in reversed(pii.spans(t)):
            t = t[:a] + f"<{kind.upper()}>" + t[b:]
        return t

    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1]))
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert sorted((r[:2] for r in got), key=key) == sorted(((i, hidden(t)) for i, t in rows), key=key)
    assert all(n == (None if t is None else len(t)) for _, t, n in got)
    assert pii.find(out).collect() == []


def test_long_text_takes_linear_time():
    for sign in ("1", "a@", "1.", "1-", "(", "A1 ", "+1 "):
        pii.spans(sign * (200_000 // len(sign)))
