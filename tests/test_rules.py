import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.operators.detect import detect_bytes
from veilspan.operators.render import mask_bytes, redact_bytes, unmask_text
from veilspan.operators.scanner import candidates, match_at, email_at, text_bytes
from veilspan.operators.segments import segment_spans
from veilspan.operators.spans import admitted, normalized
from veilspan.operators.scanner import Candidate
from veilspan.plans.queries import CASES


@pytest.mark.parametrize("text,spans", CASES)
def test_cases(text, spans):
    b = text.encode()
    assert [(label, b[s:e].decode()) for s, e, label in detect_bytes(b)] == spans


def visit_every_byte(b: bytes) -> list[Candidate]:
    """The scan without its index of interesting bytes."""
    host = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-"
    out, i = [], 0
    while i < len(b):
        if b[i] == 64 and i and (found := email_at(b, i)):
            out.append(Candidate(*found, "private_email", True))
        hit = match_at(b, i)
        if hit:
            out.append(Candidate(i, *hit))
            i = hit[0]
        elif b[i] in host and i + 4 < len(b):
            if i and b[i - 1] in host:
                i += 2
            else:
                while i < len(b) and b[i] in host:
                    i += 1
        else:
            i += 1
    return out


PIECES = ["10.0.0.1", "-", "(800) 555-0123", "+1 202 555 0147", "a@b.co", " ", ".", "https://x.y/z)", "AB12-CD34", "ONBOARDING", "2024年5月2日", "January 5, 2024", "123-45-6789", "é", "www.ab.example.com", "DE89 3704 0044 0532 0130 00", "sk-aaaaaaaaaaaaaaaaaaaa", "12 Elm St, CA 90210", "x", "@", "4111 1111 1111 1111", "12-3456789", "\n", "tel:5", "_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_scan_visits_what_matters(text):
    assert candidates(text.encode()) == visit_every_byte(text.encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_spans_and_round_trip(text):
    b = text_bytes(text)
    spans = detect_bytes(b)
    assert all(0 <= s < e <= len(b) for s, e, _ in spans)
    assert all(a[1] <= c[0] for a, c in zip(spans, spans[1:], strict=False))
    masked, entities = mask_bytes(b, spans)
    assert unmask_text(masked.decode(), entities) == text
    assert redact_bytes(b, spans).count(b"<REDACTED>") >= len(spans)


def test_same_text_same_uid():
    b = b"mail a@b.co and A@b.co and a@b.co"
    masked, entities = mask_bytes(b, detect_bytes(b))
    assert masked == b"mail <EMAIL_1> and <EMAIL_2> and <EMAIL_1>"
    assert [e[0] for e in entities] == ["EMAIL_1", "EMAIL_2", "EMAIL_1"]


def test_short_and_long_texts_trim_differently():
    for pad, start in ((0, 2), (300, 1)):
        b = b"x  @y.com" + b" " * pad
        assert [(s, e) for s, e, _ in detect_bytes(b)] == [(start + 1 if pad == 0 else 2, 9)]


def test_admission_and_order():
    spans = admitted([Candidate(5, 9, "secret"), Candidate(3, 12, "private_email", True)], [(0, 6, "private_person")])
    assert spans == [(0, 6, "private_person"), (3, 12, "private_email")]
    assert normalized([(4, 6, "a"), (0, 5, "b"), (0, 3, "c"), (5, 5, "d"), (6, 7, "e")]) == [(0, 5, "b"), (6, 7, "e")]


def test_nul_loses_nothing():
    b = text_bytes("abc\0 tail a@b.co")
    assert [(s, e, label) for s, e, label in detect_bytes(b)] == [(10, 16, "private_email")]
    assert redact_bytes(b, detect_bytes(b)) == b"abc\0 tail <REDACTED>"


@pytest.mark.parametrize("text", ["<EMAIL_1> and a@b.co", "a@b.co <EMAIL_1><EMAIL_2> c@d.org a@b.co", "x\0 a@b.co <URL_1> https://x.y"])
def test_unmasking_gives_back_texts_with_placeholders(text):
    b = text.encode()
    masked, entities = mask_bytes(b, detect_bytes(b))
    assert masked != b and unmask_text(masked.decode(), entities) == text


def test_admission_is_that_of_all_pairs():
    r = random.Random(8)
    for _ in range(300):
        known = sorted((s, s + r.randrange(1, 9), "x") for s in r.sample(range(100), r.randrange(6)))
        found = [Candidate(s, s + r.randrange(0, 12), "y", r.random() < 0.4) for s in sorted(r.choices(range(100), k=r.randrange(25)))]
        out = list(known)
        for c in found:
            if not any((s <= c.start and e >= c.end) if c.within else (s < c.end and e > c.start) for s, e, _ in out):
                out.append((c.start, c.end, c.label))
        assert admitted(found, known) == out
    many = " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(16000)).encode()
    began = time.perf_counter()
    assert len(detect_bytes(many)) == 16000 and time.perf_counter() - began < 5


def test_segments():
    text = "Dr. No met J. Doe. " + "He said hi! " * 30 + "End?\nNew line\r\n"
    b = text.encode()
    parts = [b[s:e].decode() for s, e in segment_spans(b)]
    assert parts[0] == "Dr. No met J. Doe." and parts[-2:] == ["End?", "New line"] and len(parts) == 33
    assert segment_spans(b"short. Text") == [(0, 11)]
    random.seed(0)
    for n in (255, 256, 257):
        b = bytes(random.choice(b"ab. AB?\n") for _ in range(n))
        spans = segment_spans(b)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)) and sum(len(b[s:e].split()) for s, e in spans) >= len(b.split()) - 0


def found(text: str) -> list[tuple[str, str]]:
    b = text.encode()
    return [(label, b[s:e].decode()) for s, e, label in detect_bytes(b)]


def test_an_address_behind_a_number_is_no_group_of_it():
    assert found("a 4451718024887799 27.65.93.188 b") == [("secret", "27.65.93.188")]
    assert found("a 4451 7180 2488 7799 27.65.93.188 b") == [("account_number", "4451 7180 2488 7799"), ("secret", "27.65.93.188")]
    assert found("a 4451718024887799 27.") == [("account_number", "4451718024887799 27")]


def test_digits_that_go_on_behind_a_phone_number():
    """As the rule's SQL has them."""
    assert found("a +1 (269) 555-3296 4524132264652876 b") == [("private_phone", "+1 (269) 555-3296 4524132264652876")]
    assert found("a +1 (826) 555-4081 190.137.223.204 b") == [("private_phone", "+1 (826) 555-4081 190.137")]
    assert found("a +1 (826) 555-4081 b") == [("private_phone", "+1 (826) 555-4081")]


def test_an_email_ends_before_a_part_of_one_letter():
    """As the rule's SQL has it."""
    assert found("a b.12@mail7.example.c") == [("private_email", "b.12@mail7.example")]
    assert found("a b.12@mail7.example.com.A b") == [("private_email", "b.12@mail7.example.com")]
    assert found("a b.12@mail7.c b") == []


def test_uids_go_by_the_first_place_of_a_value():
    """As the SQL of mask_uids has it: within a longer word too, and the shorter of two first."""
    b = b"a XXKEITHEITUNGEN, BEVERSCH, KEITHEITUNG, KEITHEIT, BEVERSCH b"
    masked, entities = mask_bytes(b, detect_bytes(b))
    assert masked == b"a XXKEITHEITUNGEN, <ACCOUNT_3>, <ACCOUNT_2>, <ACCOUNT_1>, <ACCOUNT_3> b"
    assert unmask_text(masked.decode(), entities) == b.decode()
    assert mask_bytes(b"xab, b, a", [(5, 6, "odd"), (8, 9, "odd")])[0] == b"xab, <PII_1>, <PII_2>"
