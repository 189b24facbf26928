import itertools
import json
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan import cli
from veilspan.config import LABELS, N_TAGS, Calibration, ModelConfig, resolve_model_dir
from veilspan.operators import detect as D
from veilspan.operators import evaluate as E
from veilspan.operators import forward as M
from veilspan.operators import render as R
from veilspan.operators import synth
from veilspan.operators.provider import ModelProvider, phrase_provider
from veilspan.operators.spans import normalize_column, normalized
from veilspan.operators.tokenizer import Tokenizer, byte_alphabet, token_ids, tokens, tokens_udf
from veilspan.operators.viterbi import allowed, boundary, tag_spans, transition_bias, viterbi
from veilspan.plans.queries import CASES, ORACLES, QUERIES, placed
from veilspan.sources import files
from veilspan.sources.safetensors import SafetensorsSource, TensorFile, tensor_entries, write_tensors

SMALL = ModelConfig(hidden=12, intermediate=6, layers=2, query_heads=4, kv_heads=2, head_dim=4, experts=5, top_k=2, window=3, vocab=300, pad_id=299)


def test_detect_redact_mask_unmask(spark):
    texts = [t for t, _ in CASES] + [None, "", "x" * 300 + " a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r.id: r for r in R.unmask(R.mask(R.redact(D.detect(df)))).collect()}
    for i, (text, spans) in enumerate(CASES):
        assert [tuple(x) for x in rows[i].spans] == [(label, start, end, value) for _, label, value, start, end in placed(text, spans)]
        assert rows[i].redacted.count("<REDACTED>") == len(spans) == len(rows[i].masked.entities)
    assert all(r.unmasked == (texts[i] or "") for i, r in rows.items())
    assert rows[len(CASES)].spans == [] and rows[len(CASES)].redacted is None
    assert D.explode_spans(D.detect(df)).where("label = 'private_email'").count() >= 3
    plan = D.detect(df, use_rules=False).where(F.size("spans") > 0)
    assert plan.count() == 0


def test_provider_spans_come_first(spark):
    df = spark.createDataFrame([(1, "Ask Alice at alice@example.com")], "id int, text string")
    provider = phrase_provider({"Alice": "private_person", "example": "secret"})
    found = D.detect(df, provider=provider).first().spans
    assert [(s.label, s.text) for s in found] == [("private_person", "Alice"), ("private_email", "alice@example.com")]
    masked = R.mask(df, provider=provider).first().masked
    assert masked.masked_text == "Ask <PERSON_1> at <EMAIL_1>"


def test_mask_json_keeps_odd_texts(spark):
    df = spark.createDataFrame([("k }\" \\ \u0001 \b a@b.co }",)], "text string")
    row = R.mask(df).select("text", R.from_mask_json(R.mask_json(F.col("masked"))).alias("masked")).select("text", R.unmask_column(F.col("masked")).alias("back")).first()
    assert row.text == row.back
    assert spark.range(1).select(R.collides(F.lit("see <EMAIL_2>"))).first()[0]


def test_normalize_column_equals_function(spark):
    r = random.Random(3)
    rows = [(i, [("secret", s := r.randint(0, 20), s + r.randint(0, 6)) for _ in range(r.randint(0, 8))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, spans array<struct<label:string,start:int,end:int>>")
    got = {x.id: [(s.start, s.end) for s in x.out] for x in df.select("id", normalize_column(F.col("spans")).alias("out")).collect()}
    assert got == {i: [(s, e) for s, e, _ in normalized([(s, e, label) for label, s, e in spans])] for i, spans in rows}


def test_tokenizer(spark, tmp_path):
    alphabet = {b: c for c, b in byte_alphabet().items()}
    encode = lambda b: "".join(alphabet[x] for x in b)
    vocabulary = {encode(bytes([b])): b for b in range(256)} | {encode(b" the"): 256, encode("é".encode()): 257, encode(b"then"): 258}
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"ignore_merges": True, "vocab": vocabulary}, "added_tokens": [{"id": 259, "content": "<x>", "special": True}, {"id": 260, "content": "<y>", "special": False}]}))
    t = files.read_tokenizer(spark, f"file://{tmp_path}/tokenizer.json")
    assert t("thé the then<x>".encode()) == [(116, 0, 1), (104, 1, 2), (257, 2, 4), (256, 4, 8), (256, 8, 12), (110, 12, 13), (259, 13, 16)]
    row = tokens(spark.createDataFrame([("hello " * 683,), (None,)], "text string"), t).collect()
    own = row[0].tokens
    assert len(own) > 512 and own[0].start == 0 and all(a.end == b.start for a, b in itertools.pairwise(own)) and row[1].tokens == []
    assert files.vocabulary_frame(spark, t).count() == 260
    with pytest.raises(ValueError):
        Tokenizer({b"a": 1})(b"ab")
    with pytest.raises(ValueError):
        Tokenizer({b"a": 9}, size=5)
    (tmp_path / "bad.json").write_text('{"model": {"vocab": {}}}')
    with pytest.raises(ValueError):
        files.read_tokenizer(spark, f"file://{tmp_path}/bad.json")


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    bias = Calibration(0.5, -0.2, 0.3, 0.1, -0.4, 0.2)
    for n in (1, 2, 3):
        scores = r.normal(size=(n, 9)).astype(np.float32)
        best = max(
            (
                sum(scores[i, c] for i, c in enumerate(p)) + sum(transition_bias(a, b, bias) for a, b in itertools.pairwise(p))
                for p in itertools.product(range(9), repeat=n)
                if boundary(p[0]) in "OBS" and boundary(p[-1]) in "OES" and all(allowed(a, b) for a, b in itertools.pairwise(p))
            )
        )
        path = viterbi(scores, bias).tolist()
        assert abs(sum(scores[i, c] for i, c in enumerate(path)) + sum(transition_bias(a, b, bias) for a, b in itertools.pairwise(path)) - best) < 1e-4
    assert viterbi(np.zeros((0, N_TAGS))).tolist() == [] and viterbi(np.zeros((3, N_TAGS))).tolist() == [0, 0, 0]


def test_tag_spans():
    tok = [(0, i, i + 1) for i in range(8)]
    b, i, e, s = 1, 2, 3, 4
    assert tag_spans(tok, [b, i, e, 0, s, b, i, 0]) == [(0, 3, LABELS[0]), (4, 5, LABELS[0]), (5, 7, LABELS[0])]
    assert tag_spans(tok[:4], [b, 4 + i, 4 + e, 0]) == [(1, 3, LABELS[1])]
    assert tag_spans(tok[:2], [e, i]) == [(0, 1, LABELS[0]), (1, 2, LABELS[0])]


def naive_forward(ids, w, c):
    """Token by token, number by number where it matters."""
    x = np.array([w["model.embed_tokens.weight"][i] for i in ids], dtype=np.float64)
    cos, sin = (t.astype(np.float64) for t in M.rope_tables(len(ids), c))
    norm = lambda v, g: v / np.sqrt((v * v).mean() + c.eps) * g
    for layer in range(c.layers):
        p, a = f"model.layers.{layer}", f"model.layers.{layer}.self_attn"
        h = np.array([norm(v, w[f"{p}.input_layernorm.weight"]) for v in x])
        heads = {}
        for name, n in (("q", c.query_heads), ("k", c.kv_heads), ("v", c.kv_heads)):
            y = np.array([w[f"{a}.{name}_proj.weight"] @ v + w[f"{a}.{name}_proj.bias"] for v in h]).reshape(len(ids), n, c.head_dim)
            if name != "v":
                for t in range(len(ids)):
                    for k in range(n):
                        for d in range(c.head_dim // 2):
                            u, v = y[t, k, 2 * d], y[t, k, 2 * d + 1]
                            y[t, k, 2 * d], y[t, k, 2 * d + 1] = u * cos[t, d] - v * sin[t, d], v * cos[t, d] + u * sin[t, d]
                y = y * c.head_dim**-0.25
            heads[name] = y
        mixed = np.zeros((len(ids), c.query_heads, c.head_dim))
        for t in range(len(ids)):
            for k in range(c.query_heads):
                js = [j for j in range(len(ids)) if abs(j - t) <= c.window]
                s = np.exp([heads["q"][t, k] @ heads["k"][j, k // (c.query_heads // c.kv_heads)] for j in js])
                total = s.sum() + np.exp(w[f"{a}.sinks"][k])
                mixed[t, k] = sum(e / total * heads["v"][j, k // (c.query_heads // c.kv_heads)] for e, j in zip(s, js, strict=True))
        x = x + mixed.reshape(len(ids), -1) @ w[f"{a}.o_proj.weight"].T + w[f"{a}.o_proj.bias"]
        for t in range(len(ids)):
            v = norm(x[t], w[f"{p}.post_attention_layernorm.weight"])
            logits = w[f"{p}.mlp.router.weight"] @ v + w[f"{p}.mlp.router.bias"]
            top = sorted(range(c.experts), key=lambda e: (-logits[e], e))[: c.top_k]
            weights = np.exp(logits[top]) / np.exp(logits[top]).sum()
            add = 0
            for e, weight in zip(top, weights, strict=True):
                both = v @ w[f"{p}.mlp.experts.gate_up_proj"][e] + w[f"{p}.mlp.experts.gate_up_proj_bias"][e]
                gate, up = np.minimum(both[: c.intermediate], 7), np.clip(both[c.intermediate :], -7, 7)
                add = add + weight * (((up + 1) * gate / (1 + np.exp(-1.702 * gate))) @ w[f"{p}.mlp.experts.down_proj"][e] + w[f"{p}.mlp.experts.down_proj_bias"][e])
            x[t] = x[t] + add
    return np.array([w["score.weight"] @ norm(v, w["model.norm.weight"]) + w["score.bias"] for v in x])


def test_forward_equals_naive():
    w = M.random_weights(SMALL)
    ids = np.array([5, 7, 299, 0, 5, 5, 100, 3, 9, 250, 11])
    assert np.allclose(M.forward(ids, w, SMALL), naive_forward(ids, w, SMALL), atol=2e-3)
    assert np.allclose(M.forward(np.array([5, 99999]), w, SMALL), M.forward(np.array([5, 299]), w, SMALL))
    assert M.top_k(np.array([[1.0, 3.0, 3.0, 2.0]]), 3).tolist() == [[1, 2, 3]]
    with pytest.raises(ValueError):
        M.top_k(np.array([[np.nan, 1.0]]), 1)


def test_small_models_run_along_the_tokens():
    c = ModelConfig(hidden=16, intermediate=8, layers=2, query_heads=4, kv_heads=2, head_dim=4, experts=6, top_k=2, window=3, vocab=256, pad_id=255)
    w, r = M.random_weights(c), np.random.default_rng(3)
    segments = [r.integers(0, 256, n) for n in (1, 0, 3, 9, 40, 2)]
    for ids, got in zip(segments, M.forward_many(segments, w, c), strict=True):
        assert got.shape == (len(ids), c.labels) and (not len(ids) or np.allclose(got, naive_forward(ids, w, c), atol=2e-3))
    ids = r.integers(0, 256, 3 * M.NARROW_ROWS // 2)
    got = M.forward(ids, w, c)
    for at in (0, M.NARROW_ROWS - 20, len(ids) - 40):  # a token sees six others to each side
        assert np.allclose(got[at + 6 : at + 34], M.forward(ids[at : at + 40], w, c)[6:34], atol=2e-3)
    assert (M.best_tags(got) == got.argmax(axis=1)).all() and (M.best_tags(np.asfortranarray(got.round())) == got.round().argmax(axis=1)).all()
    x = np.asfortranarray(r.integers(0, 3, (500, 6)).astype(np.float32))
    assert (M.top_k(x, 3) == M.top_k(np.ascontiguousarray(x), 3)).all()
    with pytest.raises(ValueError):
        M.top_k(np.asfortranarray([[np.nan, 1.0], [0.0, 2.0]]), 1)


def test_safetensors(spark, tmp_path):
    w = M.random_weights(SMALL)
    for bf16 in (False, True):
        path = tmp_path / f"m{bf16}.safetensors"
        write_tensors(path, w, bf16)
        f = TensorFile(path)
        assert set(f) == set(w) and all(np.allclose(f[k], w[k], atol=0.02 if bf16 else 0) for k in w)
    spark.dataSource.register(SafetensorsSource)
    got = spark.read.format("safetensors").load(str(path)).collect()
    assert [tuple(r) for r in got] == [tuple(e) for e in tensor_entries(path)]
    provider = ModelProvider(str(path), Tokenizer({bytes([b]): b for b in range(256)}), SMALL)
    df = spark.createDataFrame([("Some text. " * 40,), ("short",)], "text string")
    for r in D.detect(df, provider=provider).collect():
        assert all(0 <= s.start < s.end for s in r.spans)


def test_calibration_and_model_folder(tmp_path):
    assert Calibration.load(tmp_path / "none.json") == Calibration()
    (tmp_path / "c.json").write_text('{"points": [{"biases": {"transition_bias_end_to_start": 2, "other": "x"}}]}')
    assert Calibration.load(tmp_path / "c.json") == Calibration(end_to_start=2.0)
    (tmp_path / "d.json").write_text('{"transition_bias_end_to_start": "2"}')
    with pytest.raises(ValueError):
        Calibration.load(tmp_path / "d.json")
    with pytest.raises(FileNotFoundError):
        resolve_model_dir(str(tmp_path))
    assert resolve_model_dir(variables=(), folders=(str(tmp_path),)) is None


def greedy(truth, predicted, least=0.5):
    used, pairs = set(), 0
    for d, n, label, s, e in truth:
        for k, (d2, _, label2, s2, e2) in enumerate(predicted):
            if k not in used and d == d2 and label == label2 and max(0, min(e, e2) - max(s, s2)) >= least * (max(e, e2) - min(s, s2)):
                used.add(k)
                pairs += 1
                break
    return pairs, len(predicted) - pairs, len(truth) - pairs


def test_evaluate(spark):
    r = random.Random(4)

    def spans():
        out = []
        for d in range(30):
            at = 0
            for n in range(r.randint(0, 5)):
                at += r.randint(0, 4)
                out.append((d, n, r.choice(LABELS[:2]), at, at := at + r.randint(1, 8)))
        return out

    truth, predicted = spans(), spans()
    kind = "doc_id int, span_no int, label string, start int, end int"
    t, p = spark.createDataFrame(truth, kind), spark.createDataFrame(predicted, kind)
    row = E.evaluate(t, p).first()
    assert (row.tp, row.fp, row.fn) == greedy(truth, predicted)
    by = {x.label: (x.tp, x.fp, x.fn) for x in E.evaluate(t, p, ["label"]).collect()}
    assert by == {label: greedy([x for x in truth if x[2] == label], [x for x in predicted if x[2] == label]) for label in LABELS[:2]}
    nothing = E.evaluate(t, p.limit(0)).first()
    assert (nothing.tp, nothing.fn, nothing.f1) == (0, len(truth), 0.0)
    gain = E.compare(E.evaluate(t, p.limit(0), ["label"]), E.evaluate(t, t, ["label"]), ["label"]).collect()
    assert all(g.gain == 1.0 for g in gain)


def test_matching_of_competing_spans(spark):
    kind = "doc_id int, span_no int, label string, start int, end int"
    truth = [(1, 0, "a", 0, 10), (1, 1, "a", 2, 12), (1, 2, "a", 4, 14)]
    predicted = [(1, 0, "a", 1, 11), (1, 1, "a", 3, 13), (1, 2, "a", 30, 40)]
    pairs = E.match_spans(spark.createDataFrame(truth, kind), spark.createDataFrame(predicted, kind)).collect()
    assert sorted((p.truth_no, p.predicted_no) for p in pairs) == [(0, 0), (1, 1)]
    row = E.evaluate(spark.createDataFrame(truth, kind), spark.createDataFrame(predicted, kind)).first()
    assert (row.tp, row.fp, row.fn) == greedy(truth, predicted) == (2, 1, 1)


def test_predictions_and_report(spark, tmp_path):
    def breaks(b):
        if b"break" in b:
            raise RuntimeError("broken")
        return []

    span = lambda label, start, end: {"label": label, "start": start, "end": end, "text": ""}
    rows = [(1, "mail a@b.co", [span("private_email", 5, 11)], "en"), (2, "break a@b.co", [span("private_email", 6, 12)], "de"), (3, None, [], "de")]
    samples = spark.createDataFrame(rows, files.EVAL_SCHEMA.replace("text", "doc_id int, text", 1))
    made = E.predict(samples, breaks)
    got = {r.doc_id: r for r in made.collect()}
    assert got[2].error == "RuntimeError: broken" and got[2].spans == [] and got[1].error is None and len(got[1].spans) == 1 and got[3].spans == [] and all(r.ms >= 0 for r in got.values())
    E.write_report(E.report(samples, made), f"file://{tmp_path}/report")
    lines = {(r.scope, r.name): r for r in spark.read.json(f"file://{tmp_path}/report").collect()}
    total = lines["overall", ""]
    assert (total.tp, total.fp, total.fn, total.samples, total.errors) == (1, 0, 1, 3, 1) and total.avg_ms >= 0 and total.total_s >= 0
    assert lines["lang", "de"].recall == 0 and lines["lang", "en"].f1 == 1 and lines["label", "private_email"].recall == 0.5


def test_model_reads_parts_of_files(tmp_path):
    weights = M.random_weights(SMALL, 3)
    write_tensors(tmp_path / "w", weights, bf16=True)
    whole = TensorFile(tmp_path / "w")
    decoded = {k: np.array(whole[k]) for k in whole}
    assert all(np.abs(decoded[k] - weights[k]).max() < 0.02 for k in weights)
    few = TensorFile(tmp_path / "w", kept=2000)
    r = np.random.default_rng(1)
    segments = [r.integers(-2, 310, n) for n in (5, 1, 40, 0, 17)]
    segments = [np.where((x < 0) | (x >= 300), 299, x) for x in segments]
    for got, ids in zip(M.forward_many(segments, few, SMALL), segments, strict=True):
        assert len(ids) == 0 and got.shape == (0, SMALL.labels) or np.abs(got - naive_forward(ids, decoded, SMALL)).max() < 1e-3
    assert few.held <= max(2000, max(x.nbytes for x in decoded.values())) and not any(k[0] == "model.embed_tokens.weight" for k in few.decoded)


def test_texts_that_no_token_begins(spark):
    tokenizer = Tokenizer({b"a": 1, b"ab": 2, b"abc": 3, b"c": 4})
    df = spark.createDataFrame([(1, "abcab"), (2, "abx"), (3, None)], "id int, text string")
    assert {r.id: r.tokens for r in token_ids(df, tokenizer).collect()} == {1: [3, 2], 2: None, 3: []}
    assert {r.id: r.tokens and [t.text for t in r.tokens] for r in tokens(df, tokenizer).collect()} == {1: ["abc", "ab"], 2: None, 3: []}


def test_tokens_as_arrays_equal_those_one_by_one():
    r = random.Random(5)
    for _ in range(500):
        tokenizer = Tokenizer({bytes(r.choices(b"abc", k=r.randint(1, 4))): i for i in range(r.randint(1, 12))}, [(b"ab", 99)] if r.random() < 0.2 else [])
        b = bytes(r.choices(b"abc", k=r.randint(0, 12)))
        try:
            own = tokenizer(b)
        except ValueError:
            with pytest.raises(ValueError):
                tokenizer.arrays(b)
        else:
            assert own == list(zip(*(x.tolist() for x in tokenizer.arrays(b)), strict=True))


def test_tokens_of_a_batch_take_bounded_memory(spark):
    """A worker held over 300 bytes for each byte of a batch."""
    tokenizer = Tokenizer({bytes([b]): b for b in range(256)} | {b"th": 256})
    batch = pa.array(["the ü" + " and so on" * 10_000, None, "x"] * 40)
    tracemalloc.start()
    out = [x for part in tokens_udf(tokenizer).func(iter([batch])) for x in [len(part), part[0][0].as_py()]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out[::2]) == len(batch) and out[1] == {"id": 256, "start": 0, "end": 2, "text": "th"} and peak < 20 * batch.nbytes


def test_generator_and_files(spark, tmp_path):
    samples = synth.generate(spark, 100)
    assert sorted(map(str, samples.collect())) == sorted(map(str, synth.generate(spark, 100).repartition(3).collect()))
    for r in samples.collect():
        assert all(r.text.encode()[s.start : s.end].decode() == s.text for s in r.spans)
    files.write_eval(samples, f"file://{tmp_path}/eval")
    back = files.read_eval(spark, f"file://{tmp_path}/eval")
    assert back.count() == samples.count() and files.read_eval(spark, f"file://{tmp_path}/eval", 7).count() == 7
    (tmp_path / "one.txt").write_text("mail a@b.co\nnow")
    row = files.read_texts(spark, f"file://{tmp_path}/one.txt").first()
    assert row.text == "mail a@b.co\nnow"
    found = R.mask(R.redact(D.detect(files.text_frame(spark, "mail a@b.co"))))
    files.write_redacted(found, f"file://{tmp_path}/r")
    files.write_spans(found, f"file://{tmp_path}/s")
    files.write_masked(found, f"file://{tmp_path}/m")
    assert spark.read.text(f"file://{tmp_path}/r").first()[0] == "mail <REDACTED>"
    assert json.loads(spark.read.text(f"file://{tmp_path}/s").first()[0]) == [{"label": "private_email", "start": 5, "end": 11, "text": "a@b.co"}]
    assert spark.read.json(f"file://{tmp_path}/m").first().masked_text == "mail <EMAIL_1>"


def test_streams(spark, tmp_path):
    from veilspan.streaming.redaction import mask_stream, redact_stream

    rows = [("c1", 0, "mail a@b.co"), ("c2", 0, "mail z@b.co"), ("c1", 1, "a@b.co or c@b.co"), ("c1", 2, None)]
    kind = "conversation string, position bigint, text string"
    spark.createDataFrame(rows[:2], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[2:], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df in (("redacted_rows", redact_stream(source())), ("masked_rows", mask_stream(source()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
    assert {r.redacted for r in spark.table("redacted_rows").collect()} == {"mail <REDACTED>", "<REDACTED> or <REDACTED>", None}
    masked = {(r.conversation, r.position): r.masked_text for r in spark.table("masked_rows").collect()}
    first, second = masked[("c1", 0)].split()[1], masked[("c1", 1)].split(" or ")
    assert masked[("c2", 0)] == "mail <EMAIL_1>" and first in second and set(second) == {"<EMAIL_1>", "<EMAIL_2>"} and masked[("c1", 2)] == ""


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    run = lambda *args: cli.run(spark, cli.parser().parse_args(args))
    assert json.loads(run("detect", "mail a@b.co"))[0]["text"] == "a@b.co"
    assert json.loads(run("detect", "mail a@b.co", "--no-rules")) == []
    assert run("redact", "first", "mail a@b.co") == "mail <REDACTED>"
    (tmp_path / "m.json").write_text(run("mask", "mail a@b.co"))
    assert run("unmask", "--file", str(tmp_path / "m.json")) == "mail a@b.co"


def test_plans_stay_narrow(spark, tmp_path):
    spark.createDataFrame([(i, "a@b.co", "x") for i in range(10)], "doc_id int, text string, other string").write.parquet(f"{tmp_path}/d")
    plan = D.detect(spark.read.parquet(f"{tmp_path}/d")).where("doc_id < 5").select("doc_id", "spans")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThan(doc_id,5)" in plan and "Exchange" not in plan and "other" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_sql_functions(spark):
    from veilspan.functions.registered import register

    register(spark)
    spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1"), (2, None)], "id int, text string").createOrReplaceTempView("mails")
    rows = spark.sql("SELECT id, s.* FROM mails, LATERAL pii_spans(text) s ORDER BY start").collect()
    assert [tuple(r) for r in rows] == [(1, "private_email", 5, 11, "a@b.co"), (1, "secret", 15, 23, "10.0.0.1")]
    assert spark.sql("SELECT pii_redact(text) FROM mails WHERE id = 1").first()[0] == "mail <REDACTED> or <REDACTED>"
    assert D.detect(spark.createDataFrame([(synth.long_text(4000),)], "text string")).first().spans[0].text == "alice@example.com"


def test_sql_rules_look_only_where_a_value_may_be(spark, tmp_path):
    from veilspan.functions.sql_rules import SQL_RULES, rule_values
    from veilspan.plans import queries as Q

    r = random.Random(4)
    values = [v for _, spans in CASES for _, v in spans] + ["3714 496353 98431", "4111-1111-1111-1111", "ABCDEF123", "May 5 2020", "sk_live_0123456789ab", "s3://a", "gs://b/c", "tel:5"]
    rows = [(i, "".join(r.choice([*values, "Foo 1", "é", "-", "."]) + r.choice([" ", "\n", ", ", "x"]) for _ in range(r.randint(0, 6)))) for i in range(600)]
    df = spark.createDataFrame([*((i, v) for i, v in enumerate(values, 1000)), *rows, (-1, None)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for name, (_, pattern) in SQL_RULES.items():
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        assert df.where(~rule_values(F.col("text"), name).eqNullSafe(whole)).count() == 0
        assert df.where(F.size(whole) > 0).count()
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = Q.sql_rule_hits(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # the texts were read for each of six unions, and cut anew


def test_forward_scores_cover_whole_texts(spark, tmp_path):
    from veilspan.plans import queries as Q

    long = "One sentence of some words. " * 40 + "\nand a last line"
    rows = [(1, long), (2, long[:-1] + "f"), (3, "short ü"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.forward_scores(spark, str(tmp_path)).collect()}
    c = ModelConfig(hidden=16, intermediate=8, layers=2, query_heads=4, kv_heads=2, head_dim=4, experts=6, top_k=2, window=3, vocab=256, pad_id=255)
    w = M.random_weights(c)
    pieces = ["One sentence of some words.\n"] * 40 + ["and a last line\n"]
    naive = [naive_forward(np.frombuffer(p.encode(), dtype=np.uint8), w, c) for p in dict.fromkeys(pieces)]
    assert got[1].n_tokens == sum(map(len, pieces)) and got[3].n_tokens == 8 and got[4].n_tokens == got[5].n_tokens == 0
    assert np.allclose(got[1].scores, 40 * naive[0].sum(axis=0) + naive[1].sum(axis=0), atol=0.5, rtol=1e-3)
    assert got[1].scores != got[2].scores  # the last byte counts


#: Values that meet others: an address behind a card, digits behind a phone number, a cut e-mail; values that stand within a longer word first.
MEETING = ["a XXENKEITHEITUNG, BEVERSCH, KEITHEIT b", "a XXKEITHEITUNGEN, BEVERSCH, KEITHEITUNG, KEITHEIT b", "a 4451718024887799 27.65.93.188 b", "a +1 (269) 555-3296 4524132264652876 b", "a +1 (826) 555-4081 190.137.223.204 b", "a b.12@mail7.example.c"]


@pytest.mark.parametrize("name", ["label_census", "mask_documents", "mask_uids"])
def test_queries_of_values_that_meet_equal_their_sql(spark, tmp_path, name):
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(MEETING)], "doc_id bigint, text string, lang string").write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
