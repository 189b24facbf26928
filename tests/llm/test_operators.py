"""Each operator against a brute-force version on small tables with nulls, empty, blank and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chat_format, decontamination, license_scan, line_dedup, lz_fingerprint, near_dedup, packing, rare_prefix, substring_dedup, toxicity, url_filters
from veilspan.llm.common import ascii_lowered, space_words

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
VOCABULARY = ["ab", "Be", "ca", "dé", "EF", "fi", "gu", "hà", "iß", "jo", "kä", "lu"]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_texts():
    r = random.Random(5)
    words = VOCABULARY + [a + b for a in VOCABULARY for b in VOCABULARY]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n))
    out = [text(r.choice([3, 10, 40, 90])) for _ in range(40)]
    long = text(6000)
    for base in (out[3], out[7] + text(80), text(120)):
        for k in range(6):
            own = base.split(" ")
            for _ in range(k):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
    passage = text(50)
    out += [text(20) + passage + text(15) for _ in range(5)] + [passage * 3, long, long[:9000] + text(50)]
    out += [None, "", "  \n\t ", "x" * 5000, "single", "Ünicode 漢字 🙂 \x0b tab\tend", out[5], out[5], "a b c d", "a b c d e", "a\x1cb a\x85b\xa0c"]
    return out


TEXTS = made_texts()
ROWS = [(3 * i - 20, t, f"L{i % 3}") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, x, "clash", 1, True, "q") for d, t, x in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, kind int, kept boolean, block string").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id():
    return sorted(set((d, t or "") for d, t, _ in ROWS))


def test_word_helpers_on_parts_of_arrays():
    whole = pa.array(["Éa B", "", " x  Y ", "ÀB\x0bc"], pa.large_string())
    part = whole.slice(1)
    assert ascii_lowered(part).to_pylist() == ["", " x  y ", "Àb\x0bc"]
    offsets, words = space_words(part)
    assert offsets.tolist() == [0, 0, 2, 4] and words.to_pylist() == ["x", "Y", "ÀB", "c"]


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_decontamination(spark, docs, none, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    long = words(TEXTS[3] + TEXTS[7])
    items = [(1, " ".join(long[:12])), (2, "SINGLE"), (2, "single"), (3, None), (4, ""), (10, " ".join(words(TEXTS[60])[5:30])), (5, "nowhere to be found"), (6, "ab")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[s : s + 10])].add(i)
    expected = {}
    for d, t in by_id():
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        listed = ",".join(sorted(map(str, found)))
        expected[d] = (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    rows = decontamination.contamination(docs, bench).collect()
    assert len(rows) == len(ROWS) and sum(r.contaminated for r in rows) > 5
    assert all(expected[r.doc_id] == tuple(r)[1:] for r in rows)
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b c"), (2, "a x x x x b c"), (3, "b"), (4, None)], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    index = decontamination.build_index(docs, terms)
    queries = spark.createDataFrame([(7, ["a", "b"]), (8, ["a", "zz"]), (9, [])], "query_id int, terms array<string>")
    assert [tuple(r) for r in decontamination.proximity_matches(index, queries, 3).collect()] == [(7, 1, 0)]


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    clean = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = r.sample(clean, 12)
        # a group's name or an insult alone is harmless; both together are toxic
        kind = i % 4
        if kind in (1, 3):
            words[2] = "groupname"
        if kind in (2, 3):
            words[7] = "insulting"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 3)))
    labels += [(0, None), (None, 1), (1, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.train_toxicity(d.where("doc_id < 400"), lab)
    scored = {x.doc_id: x.score for x in toxicity.score_toxicity(d.where("doc_id >= 400"), machine).collect()}
    toxic = [s for i, s in scored.items() if i % 4 == 3]
    other = [s for i, s in scored.items() if i % 4 != 3]
    assert np.mean([s >= 0.3 for s in toxic]) > 0.95 and np.mean([s < 0.3 for s in other]) > 0.95
    out = toxicity.score_toxicity(docs, machine)
    assert out.count() == len(ROWS) and out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= x.score <= 1 for x in out.collect())
    assert toxicity.score_toxicity(none, machine).count() == 0
    empty = toxicity.train_toxicity(none, lab)
    assert 0 <= empty.scores(np.array([0, 0]), np.zeros(0, dtype=np.int64))[0] <= 1


def test_machine_scores_by_naive_pairs():
    r = np.random.default_rng(6)
    size = 1 << toxicity.SLOT_BITS
    machine = toxicity.FactorizationMachine(-0.3, np.zeros(size, np.float32), np.zeros((size, 4), np.float32), np.zeros(size, np.float32))
    used = r.choice(size, 40, replace=False)
    machine.weights[used], machine.factors[used], machine.rarity[used] = r.normal(size=40), r.normal(size=(40, 4)), r.random(40)
    sets = [np.sort(r.choice(used, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    got = machine.scores(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets))
    for score, own in zip(got, sets, strict=True):
        norm = sum(float(machine.rarity[i]) ** 2 for i in own) ** 0.5
        share = {i: toxicity.SHARE_NORM * float(machine.rarity[i]) / norm for i in own}
        total = -0.3 + sum(float(machine.weights[i]) for i in own)
        total += sum(share[i] * share[j] * float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for a, i in enumerate(own) for j in own[:a])
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-6


def test_toxicity_learns_crossed_pairs():
    r = random.Random(3)
    pairs = [("alpha", "bravo"), ("gamma", "delta"), ("alpha", "delta"), ("gamma", "bravo")]  # the first two are toxic; no word alone tells
    texts = [" ".join(r.sample([f"w{r.randrange(60)}" for _ in range(10)] + list(pairs[i % 4]), 12)) for i in range(600)]
    labels = np.array([int(i % 4 < 2) for i in range(600)])
    offsets, slots = toxicity.term_slots(pa.array(texts, pa.large_string()))
    machine = toxicity.fit_machine([slots[offsets[i] : offsets[i + 1]] for i in range(400)], labels[:400])
    right = lambda m: np.mean((m.scores(offsets, slots) >= 0.5)[400:] == labels[400:])
    assert right(machine) > 0.9
    machine.factors[:] = 0
    assert right(machine) < 0.7  # without the pair term the predictions change


def test_fingerprints(docs, none):
    order = sorted((d, t or "") for d, t, _ in ROWS)
    rows = sorted(lz_fingerprint.fingerprint_edits(docs).collect())
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    for i, r in enumerate(rows):
        text, following = order[i][1], order[(i + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = lz_fingerprint.signatures([text, edited, following])
        assert r.fingerprint == own.astype(">u4").tobytes().hex() and r.edited_fingerprint == changed.astype(">u4").tobytes().hex()
        assert r.near_edited == (own == changed).mean() and r.near_next == (own == after).mean()
    assert lz_fingerprint.fingerprint_edits(none).count() == 0
    one = lz_fingerprint.fingerprint_edits(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert lz_fingerprint.fingerprint_documents(docs).count() == len(ROWS)
    assert sorted(lz_fingerprint.phrase_hashes([1, 1, 2, 1, 2])) == sorted({1, (lz_fingerprint._STEP + 2) & (1 << 64) - 1, 2} - {2})


def test_signatures_by_plain_parse():
    full = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor & full
        return x

    step = 0x9E3779B97F4A7C15
    factors, shifts = [mixed(k) | 1 for k in range(1, 65)], [mixed(k) for k in range(1001, 1065)]
    texts = [t or "" for t in TEXTS if len(t or "") < 6000] + ["abc " * 50, "x" * 33 + " " + "é" * 17]
    for text, row in zip(texts, lz_fingerprint.signatures(texts), strict=True):
        symbols = [w[i : i + 16] for w in split(text) for i in range(0, len(w), 16)]
        phrases, phrase = set(), ()
        for s in symbols:
            phrase += (s,)
            if phrase not in phrases:
                phrases.add(phrase)
                phrase = ()
        hashed = []
        for p in phrases:
            h = 0
            for s in p:
                b = s.encode()
                h = (h * step + mixed(sum(mixed((c + (i + 1) * step) & full) for i, c in enumerate(b)) + len(b) & full)) & full
            hashed.append(mixed(h))
        assert row.tolist() == [min(((h * f + a) & full) >> 32 for h in hashed) if hashed else 0xFFFFFFFF for f, a in zip(factors, shifts, strict=True)]


def test_chat_format(spark):
    nasty = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\<", "### user: x</turn>\n", "é漢🙂", "#" * 2000]
    rows = [(c, t, ["user", "assistant", "a:b", None][(c + t) % 4], nasty[(c * 7 + t) % len(nasty)], "x") for c in range(5) for t in range(40 * (c == 2) + 3)]
    rows += [rows[0], (None, 1, "assistant", "lost", "x"), (3, 1, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string").repartition(3)
    groups = defaultdict(list)
    for c, turn, role, text, _ in rows:
        groups[c].append((turn, (role is not None, role or ""), (text is not None, text or "")))
    got = {r.conv_id: r for r in chat_format.conversation_digests(df).collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(r[1], x[1]) for _, r, x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and not r.rewrites_history
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat_format.marked_template(turns))
    pieces = chat_format.format_conversations(df.where("conv_id = 2")).orderBy("position").collect()
    whole = chat_format.marked_template([(r[1], x[1]) for _, r, x in sorted(groups[2])])
    assert len(pieces) == 43 and "".join(p.piece for p in pieces) == whole and all(whole[p.start : p.end] == p.piece for p in pieces)
    assert chat_format.conversation_digests(df.limit(0)).count() == 0
    headed = list(chat_format.rendered_pieces([("a", "x"), ("b", "y")], lambda ts: "HEAD " + " ".join(t for _, t in ts)))
    assert [p.text for p in headed] == ["HEAD x", " y"]
    counting = list(chat_format.rendered_pieces([("a", "x"), ("b", "y")], lambda ts: f"{len(ts)} turns: " + " ".join(t for _, t in ts)))
    assert counting[1].rewrites


def test_long_conversations_of_any_template(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(43)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string").repartition(3)
    numbered = lambda ts: "<s>" + "".join(f"{k} {r}: {t}\n" for k, (r, t) in enumerate(ts))
    rows = chat_format.format_conversations(df, numbered).orderBy("position").collect()
    assert "".join(r.piece for r in rows) == numbered(turns) and not any(r.rewrites_history for r in rows)
    assert all(numbered(turns)[r.start : r.end] == r.piece for r in rows)
    dropping = lambda ts: "<s>" + "".join(f"{r}: {t}\n" for k, (r, t) in enumerate(ts) if k != 5 or len(ts) <= 40)
    rows = chat_format.format_conversations(df, dropping).orderBy("position").collect()
    assert [r.position for r in rows if r.rewrites_history] == [40]
    assert all(dropping(turns[: k + 1])[r.start : r.end] == r.piece and r.end == len(dropping(turns[: k + 1])) for k, r in enumerate(rows))
    window = lambda ts: "".join(f"{r}: {t}\n" for r, t in ts[-36:])
    assert [k for k, p in enumerate(chat_format.rendered_pieces(turns, window)) if p.rewrites] == list(range(36, 43))
    seen = []
    assert len(list(chat_format.rendered_pieces(turns, lambda ts: seen.append(len(ts)) or chat_format.marked_template(ts), concatenative=True))) == 43 and max(seen) == chat_format.REMEMBERED


def lines_expected(rows):
    """(doc_id, text): what is kept, where a line goes that is similar to one of a smaller (doc_id, line number)."""
    every = sorted((d, i, frozenset(split(line.translate(LOWER)))) for d, t in rows for i, line in enumerate(t.split("\n")))
    out = {}
    for d, t in rows:
        lines = t.split("\n")
        gone = set()
        for i, line in enumerate(lines):
            s = frozenset(split(line.translate(LOWER)))
            if s and any((e, j) < (d, i) and 100 * len(s & x) >= 80 * len(s | x) for e, j, x in every):
                gone.add(i)
        out[(d, t)] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("neighbours", [512, 1])
def test_line_dedup_of_crowds_and_of_texts_under_one_id(spark, neighbours, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", neighbours)
    r = random.Random(11)
    base = [f"w{k}" for k in range(20)]
    near = lambda n: " ".join(r.sample(base, 20 - n) + [f"x{r.randrange(40)}" for _ in range(n)])
    rows = [(k, "\n".join([near(r.randrange(5)), f"own {k} line", near(r.randrange(1, 7))])) for k in range(60)]
    rows += [(7, "another text\n" + near(2)), (7, near(3) + "\nshort"), (7, rows[7][1]), (30, rows[31][1])]
    got = line_dedup.remove_similar_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), extra="text").collect()
    expected = lines_expected(sorted(set(rows)))
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 40
    assert all(expected[(r.doc_id, r.extra)] == (r.n_lines, r.n_removed, r.kept) for r in got)


def test_line_dedup(docs, none):
    sets, expected = [], {}
    for d, t in by_id():
        lines, kept = t.split("\n"), []
        for line in lines:
            s = frozenset(split(line.translate(LOWER)))
            if s and any(100 * len(s & x) >= 80 * len(s | x) for x in sets):
                continue
            kept.append(line)
        for line in lines:
            if s := frozenset(split(line.translate(LOWER))):
                sets.append(s)
        # lines of one document count too
        own, kept = [], []
        before = sets[: len(sets) - sum(1 for x in lines if split(x))]
        for line in lines:
            s = frozenset(split(line.translate(LOWER)))
            if not (s and any(100 * len(s & x) >= 80 * len(s | x) for x in before + own)):
                kept.append(line)
            if s:
                own.append(s)
        expected[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    rows = line_dedup.remove_similar_lines(docs, extra="lang").collect()
    assert len(rows) == len(ROWS)
    assert all(expected[r.doc_id] == (r.n_lines, r.n_removed, r.kept) for r in rows)
    assert all(r.extra == dict((d, x) for d, _, x in ROWS)[r.doc_id] for r in rows) and sum(r.n_removed for r in rows) > 10
    assert line_dedup.remove_similar_lines(none).count() == 0


def test_similar_candidates_lose_nothing():
    r = np.random.default_rng(0)
    rows = []
    for i in range(60):
        base = r.choice(30, size=r.integers(1, 12), replace=False)
        rows.append(sorted(base.tolist()))
    for percent in (60, 80, 95):
        tokens, sizes, positions, owner, sketches = [], [], [], [], []
        for i, s in enumerate(rows):
            for p in range(len(s) - -(-percent * len(s) // 100) + 1):
                tokens.append(s[p]), sizes.append(len(s)), positions.append(p), owner.append(i)
                sketches.append(np.bitwise_xor.reduce(np.uint64(1) << np.array(s, dtype=np.uint64)))
        order = np.lexsort((sizes, tokens))
        arrays = [np.array(x)[order] for x in (tokens, sizes, positions, sketches)]
        a, b = rare_prefix.similar_candidates(*arrays, percent)
        own = np.array(owner)[order]
        found = {frozenset(x) for x in zip(own[a].tolist(), own[b].tolist(), strict=True)}
        for i in range(60):
            for j in range(i):
                x, y = set(rows[i]), set(rows[j])
                assert 100 * len(x & y) < percent * len(x | y) or frozenset((i, j)) in found


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_url_filters(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", broadcast)
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://x.org", "https://x.org/", "ftp://notexample.org/es/", "http://b.com/de/1", "http://b.com/fr/", None, "", "nonsense", "://", "http:///path", "http://" + "a." * 300 + "com/de/" + "p" * 5000, "http://ÉX.com/de/", "http://u@example.org:80/es/"]
    df = spark.createDataFrame([(i % 12, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id bigint, url string, host string, rule string")
    rules = [*url_filters.RULES, ("com", "/de/", "block"), (None, "/", "block"), ("b.com", "/fr/", "allow")]
    got = url_filters.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[1])
    assert all(r.verdict == "allow" and r.rule is None for r in url_filters.filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).collect())


@pytest.mark.parametrize("crowded", [5000, 1])
def test_substring_dedup(docs, none, crowded, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "SUFFIXES_AT_ONCE", 10 * crowded)
    seen, expected = set(), {}
    for d, t in by_id():
        w = t.encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(tuple(w[s : s + 20]))
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        expected[d] = (len(w), len(w) - len(kept), b" ".join(kept).decode())
    rows = substring_dedup.remove_repeated_windows(docs).collect()
    assert len(rows) == len(ROWS) and sum(r.n_removed for r in rows) > 500
    assert all(expected[r.doc_id] == tuple(r)[1:] for r in rows)
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def test_subtrees_hold_whole_prefixes():
    r = np.random.default_rng(4)
    words = np.concatenate([r.integers(0, 2, 400), np.zeros(60)]).astype(np.uint32)
    at = np.arange(len(words) - 9)
    groups = list(substring_dedup.subtrees(words, at, 10, 12))
    assert sorted(np.concatenate(groups).tolist()) == at.tolist()
    group_of = {int(i): g for g, own in enumerate(groups) for i in own}
    place = defaultdict(set)
    for i in at.tolist():
        place[tuple(words[i : i + 10])].add(group_of[i])
    assert all(len(x) == 1 for x in place.values())
    assert all(len(own) <= 12 or len({tuple(words[i : i + 10]) for i in own.tolist()}) == 1 for own in groups)


def test_repeated_leaves():
    words = np.array([[0, 1], [0, 2], [0, 1], [0, 1], [5, 0]], dtype=np.uint32)
    assert sorted(substring_dedup.repeated_leaves(words, np.array([4, 1, 2, 2, 0]), np.array([0, 0, 7, 3, 0]))) == [0, 2]


def test_license_scan(spark, docs):
    mit = license_scan.TEMPLATES[2][1]
    texts = ["intro\nReleased under the MIT License.\nend", mit.replace(". ", ".\n").upper(), mit.replace("software", "program", 1) + " more words", "Licensed under the Apache License, Version 2.0", "licensed under cc by", None, "", "Licensed under CC BY-NC 4.0.\n\nReleased   under *the* MIT license"]
    rows = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    got = {(r.doc_id, r.license): (round(r.score, 3), r.first_line, r.last_line) for r in license_scan.scan_licenses(rows).collect()}
    assert got[(0, "MIT")] == (1.0, 1, 1) and got[(3, "Apache-2.0")] == (1.0, 0, 0) and got[(7, "MIT")] == (1.0, 2, 2) and got[(7, "CC-BY-NC-4.0")] == (1.0, 0, 0)
    assert got[(1, "MIT")][0] == 1.0 and 0.9 < got[(2, "MIT")][0] < 1
    assert {d for d, _ in got} == {0, 1, 2, 3, 7}
    known = [license_scan.Template(n, t, license_scan.THRESHOLD) for n, t in license_scan.TEMPLATES]
    for d, t in enumerate(texts):
        lines = [license_scan.words_of(x) for x in (t or "").split("\n")]
        lines = [x for x in lines if x]
        found = set()
        for k in known:
            for a in range(len(lines)):
                for b in range(a + 1, len(lines) + 1):
                    if license_scan.dice(license_scan.Counter(license_scan.bigrams_of(sum(lines[a:b], []))), k.bigrams) >= license_scan.THRESHOLD:
                        found.add(k.name)
        assert found == {name for x, name in got if x == d}
    assert license_scan.scan_licenses(docs).count() == 0


def test_license_scan_within_lines(spark):
    mit = license_scan.TEMPLATES[2][1]
    gpl = dict(license_scan.TEMPLATES)["GPL-3.0"]
    texts = ["Copyright (c) 2021 Jane Doe. Released under the MIT License.", "<p>" + "word " * 300 + mit + " other" * 300, "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 1.1.", "before it\n" + " ".join(gpl.split()) + " and after", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.license): (round(r.score, 3), r.first_line, r.last_line) for r in license_scan.scan_licenses(rows).collect()}
    assert got == {(0, "MIT"): (1.0, 0, 0), (1, "MIT"): (1.0, 0, 0), (2, "GPL-2.0"): (1.0, 0, 0), (4, "GPL-3.0"): (1.0, 1, 1), (5, "CC-BY-NC-ND-4.0"): (0.88, 0, 0)}
    r = random.Random(2)
    known = license_scan.Template("x", "a b a b c d e f", 0.6)
    for _ in range(200):
        words = [r.choice("abcdefg") for _ in range(r.randrange(2, 16))]
        scores = [license_scan.dice(license_scan.Counter(license_scan.bigrams_of(words[i:j])), known.bigrams) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        found = license_scan.best_units(" ".join(words), [known])
        assert found == [] if max(scores) < 0.6 - 1e-9 else abs(found[0][1] - max(scores)) < 1e-9


def test_packing(docs, none):
    path = packing.tokenizer_file()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64, keep_ids=True).collect()
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in by_id()}
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d, _, _ in ROWS)
    bins = defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + 64]
        assert r.start == 64 * r.piece and r.length == len(own) and r.ids == own
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    loads: list[int] = []  # first fit, longest first
    for n in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, load in enumerate(loads) if load + n <= 64), len(loads))
        loads[at:at + 1] = [(loads[at] if at < len(loads) else 0) + n]
    assert len(bins) <= len(loads)
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("name,by_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokenizers_encode_whole_texts(name, by_words):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = [t or "" for t in TEXTS] + ["it's  we'll\tDON'T  ", " e\u0301 \u0301x \u212b\u00a0y", "<|endoftext|> a<|endoftext|>b", "3.14 1,000 ... !!", "İstanbul ǅ \u1e9b\u0323"]
    encode = packing.WordTokenizer(path)
    offsets, ids = encode(pa.array(texts, pa.large_string()))
    whole = Tokenizer.from_file(path)
    assert encode.by_words == by_words
    encode.words = 50  # what is forgotten changes nothing
    for at in range(0, len(texts), 5):
        again, found = encode(pa.array(texts[at : at + 5], pa.large_string()))
        assert found.tolist() == ids[offsets[at] : offsets[min(at + 5, len(texts))]].tolist()
    assert all(ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_pack_lengths_is_close_to_the_bound():
    r = random.Random(2)
    for _ in range(20):
        capacity = r.choice([10, 50, 2048])
        counts = {r.randint(1, capacity): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        patterns = packing.pack_lengths(counts, capacity)
        placed = defaultdict(int)
        for times, pattern in patterns:
            assert sum(n * c for n, c in pattern.items()) <= capacity
            for n, c in pattern.items():
                placed[n] += times * c
        assert dict(placed) == counts
    assert packing.fullest({3: 2, 5: 1}, 9) == {3: 1, 5: 1} and packing.fullest({4: 1}, 3) == {}


def least_alike(rows, width):
    """rows (key, text): for each key its number of shingles and the smallest key that links reach."""
    sets = {}
    for d, t in rows:
        w = split(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(docs, none, width):
    expected = least_alike(by_id(), width)
    rows = near_dedup.near_duplicates(docs, width=width).collect()
    assert len(rows) == len(ROWS) and sum(not r.kept for r in rows) > 5
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_texts_under_one_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (5, text(1) + " end"), (5, text(2)), (5, text(3)), (5, text(3)), (9, text(3) + " end"), (None, text(1))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_near_dedup_passes_over_few_pairs():
    from math import ceil, comb

    least = ceil(64 * near_dedup.LEAST_AGREEMENT)
    assert sum(comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(least)) < 3e-8  # little beside the 3e-7 of the regions


def test_near_dedup_finds_stars(spark):
    """Copies that are close to a common source but not to each other."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        own = list(base)
        for k in r.sample(range(0, 300, 5), 6):
            own[k] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, width=5).collect()}
    assert set(got.values()) == {0}


def test_components(spark):
    from veilspan.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 400)] + [(5, 7), (7, 5), (9, 9), (5, 6), (900, 2), (900, 3), (3, 800)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert all(got[i] == 100 for i in range(100, 401)) and got[6] == got[7] == got[5] == 5 and {got[x] for x in (900, 2, 3, 800)} == {2} and 9 not in got


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en", "s", len(t or ""), {d: "x"}, i) for i, (d, t, _) in enumerate(ROWS)]
    rows += [(7, "another text under a known id " + VOCABULARY[0], "en", "s", 1, {}, 900), (None, TEXTS[3], "en", "s", 2, None, 901)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, `text_mark` map<bigint,string>, `a``b.c` bigint"
    spark.createDataFrame(rows, kind).withColumn("at", F.expr("timestamp'2024-01-01 10:00:00.123456' + make_interval(0,0,0,n_chars)")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int((d or 0) % 5 == 0), 0) for d, _, _ in ROWS], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[60])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    every = {r["a`b.c"]: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        out[name] = made.collect()
        assert len(out[name]) <= len(every)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        for r in out[name]:  # all columns but those that a stage changes stay, microseconds and maps among them
            was = every[r["a`b.c"]]
            assert [x for k, x in r.asDict().items() if k not in ("text", "n_chars")] == [x for k, x in was.asDict().items() if k not in ("text", "n_chars")]
            assert name == "line_dedup" or (r.text, r.n_chars) == (was.text, was.n_chars)
    known = [r for r in every.values() if r.doc_id is not None]
    assert {r["a`b.c"] for r in out["toxicity"]} == set(every)  # no label is toxic
    expected = lines_expected(sorted({(r.doc_id, r.text or "") for r in known}))
    lines = {r["a`b.c"]: r for r in out["line_dedup"]}
    for r in known:
        _, gone, kept = expected[(r.doc_id, r.text or "")]
        if gone and not split(kept):
            assert r["a`b.c"] not in lines
        else:
            got = lines[r["a`b.c"]]
            assert got.text == (kept if gone else r.text) and got.n_chars == (len(kept) if gone else r.n_chars)
    firsts = least_alike(sorted({((r.doc_id, r.text or ""), r.text or "") for r in known}), 5)
    assert sorted((r.doc_id, r.text or "") for r in out["near_dedup"] if r.doc_id is not None) == sorted(k for k, (_, first) in firsts.items() if first == k)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda t: {tuple(words(t)[i : i + 10]) for i in range(len(words(t)) - 9)}
    dirty = {r.doc_id for r in known if runs(r.text) & runs(TEXTS[60])}
    assert dirty and sorted(r["a`b.c"] for r in out["decontamination"]) == sorted(k for k, r in every.items() if r.doc_id not in dirty)
    assert all([r for r in out[name] if r.doc_id is None] for name in out)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and packed.count() > 10
