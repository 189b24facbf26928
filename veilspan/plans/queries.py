"""Queries over the test tables, and the same in SQL.

Texts are those of documents and, under negative ids, the examples of this package, so that every rule has something to find.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LABELS, N_TAGS, PREFIXES, Calibration, ModelConfig, tag_name
from ..functions.sql_rules import SQL_RULES, may_have, rule_hits
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import render as R
from ..operators import spans as S
from ..operators import synth
from ..operators import forward as M
from ..operators.detect import detect_bytes
from ..operators.scanner import rule_at
from ..operators.segments import ABBREVIATIONS, segment_bytes, segment_spans
from ..operators.tokenizer import Tokenizer, token_ids, tokens
from ..operators.viterbi import allowed, tag_spans, transition_bias, viterbi
from .examples import EDGES, EXAMPLES

CASES = [*EXAMPLES, *((text, spans) for _, text, spans in EDGES)]
TEXTS = [text for text, _ in EXAMPLES]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = spark.createDataFrame([(-1 - i, t, "xx") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string")
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(examples)


TEXTS_SQL = "texts AS (SELECT doc_id, text, lang FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(t)}, 'xx')" for i, t in enumerate(TEXTS)) + ") v(doc_id, text, lang))"


def keeping(name: str) -> tuple[str, str]:
    """A rule's pattern that also captures what stands around the value, and a replacement that keeps it."""
    pattern = SQL_RULES[name][1].replace("(?:^", "(^", 1)
    around = pattern.rpartition("(?:")
    behind = around[2].endswith(r"|\z)")
    return (around[0] + "(" + around[2], r"\1%s\3") if behind else (pattern, r"\1%s")


def without_sql(names: list[str], text: str = "text", put: str = " ") -> str:
    """SQL for the text with the values of the rules, one rule after the other, replaced."""
    for name in names:
        pattern, kept = keeping(name)
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(kept % put)}, 'g')"
    return text


#: Rules whose values another rule must not look into, each in the text without the ones before; then all others.
_FIRST = ["scheme_url", "scheme_secret", "scheme_phone", "email", "intl_phone"]
_ORDER = _FIRST + [n for n in SQL_RULES if n not in _FIRST]


def hits_sql(name: str) -> str:
    label, pattern = SQL_RULES[name]
    source = f"rest{_FIRST.index(name) if name in _FIRST else len(_FIRST)}"
    return f"SELECT doc_id, lang, '{name}' AS rule, '{label}' AS label, unnest(regexp_extract_all({source}, {quoted(pattern)}, 1)) AS value FROM rest"


_REST = ["text AS rest0"]
for _k, _n in enumerate(_FIRST):
    _REST.append(f"{without_sql([_n], f'rest{_k}')} AS rest{_k + 1}")
TEXTS_SQL += f", rest AS (SELECT doc_id, lang, text, {', '.join(_REST)} FROM texts)"
HITS_SQL = f"WITH {TEXTS_SQL}, hits AS ({' UNION ALL '.join(map(hits_sql, SQL_RULES))})"


_SCHEME_RULES = {"private_url": "scheme_url", "secret": "scheme_secret", "private_phone": "scheme_phone"}


def named_rules(b: bytes) -> list[dict]:
    """Spans of a text with the rules that gave them."""
    out = []
    for start, end, label in detect_bytes(b):
        hit = rule_at(b, start)
        rule = "email" if label == "private_email" else hit[0] if hit else None
        out.append({"rule": _SCHEME_RULES[label] if rule == "scheme_url" else rule, "label": label, "value": b[start:end].decode()})
    return out


def rule_spans(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, rule, label, value) of the scan over all texts."""

    @F.pandas_udf("array<struct<rule:string,label:string,value:string>>")
    def named(values):
        return values.map(lambda t: named_rules((t or "").encode()))

    return texts(spark, sf_dir).select("doc_id", "lang", F.explode(named("text")).alias("x")).select("doc_id", "lang", "x.*")


for _name in SQL_RULES:

    @query(f"rule_{_name}", f"WITH {TEXTS_SQL}, hits AS ({hits_sql(_name)}) SELECT doc_id, label, value FROM hits")
    def _rule(spark, sf_dir, name=_name):
        return rule_spans(spark, sf_dir).where(F.col("rule") == name).select("doc_id", "label", "value")


@query("sql_rule_hits", f"{HITS_SQL} SELECT doc_id, rule, label, value FROM hits")
def sql_rule_hits(spark, sf_dir):
    """The patterns for plain SQL, in the JVM, in one pass over the texts."""
    t = texts(spark, sf_dir).select("doc_id", F.col("text").alias("rest0"))
    for k, name in enumerate(_FIRST):
        pattern, kept = keeping(name)
        rest = F.col(f"rest{k}")
        t = t.withColumn(f"rest{k + 1}", F.when(~may_have(rest, name), rest).otherwise(F.regexp_replace(rest, pattern, (kept % " ").replace("\\", "$"))))
    return rule_hits(t, _ORDER, of={name: f"rest{min(k, len(_FIRST))}" for k, name in enumerate(_ORDER)}).select("doc_id", "rule", "label", "value")


@query("label_census", f"{HITS_SQL} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY label")
def label_census(spark, sf_dir):
    return rule_spans(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("label_census_by_lang", f"{HITS_SQL} SELECT lang, label, count(*) AS n FROM hits GROUP BY GROUPING SETS ((lang, label), (label), (lang), ())")
def label_census_by_lang(spark, sf_dir):
    sets = [[F.col("lang"), F.col("label")], [F.col("label")], [F.col("lang")], []]
    return rule_spans(spark, sf_dir).groupingSets(sets, "lang", "label").agg(F.count("*").alias("n"))


@query("docs_with_pii", f"{HITS_SQL} SELECT lang, count(*) AS n_docs, count(h.doc_id) AS n_with FROM texts t LEFT JOIN (SELECT DISTINCT doc_id FROM hits) h USING (doc_id) GROUP BY lang")
def docs_with_pii(spark, sf_dir):
    found = D.detect(texts(spark, sf_dir)).select("lang", F.size("spans").alias("n"))
    return found.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") > 0).alias("n_with"))


_PREFIX_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREFIXES.items()) + " ELSE 'PII' END"


@query(
    "mask_uids",
    f"""{HITS_SQL}, first AS (SELECT DISTINCT h.doc_id, label, value AS text, strpos(t.text, value) AS first FROM hits h JOIN texts t USING (doc_id))
    SELECT doc_id, label, text, {_PREFIX_SQL} || '_' || row_number() OVER (PARTITION BY doc_id, label ORDER BY first, text) AS uid FROM first""",
)
def mask_uids(spark, sf_dir):
    entities = R.mask(texts(spark, sf_dir)).select("doc_id", F.explode("masked.entities").alias("e")).select("doc_id", "e.label", "e.text", "e.uid")
    return entities.distinct()


@query("mask_uids_of_conversations", "SELECT conv_id, label, text, CASE label WHEN 'private_email' THEN 'EMAIL' ELSE 'PII' END || '_' || row_number() OVER (PARTITION BY conv_id, label ORDER BY first, text) AS uid FROM (SELECT conv_id, label, text, min(turn) AS first FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'private_email' ELSE role END AS label, left(text, 3) AS text FROM conversations WHERE text IS NOT NULL) GROUP BY ALL)")
def mask_uids_of_conversations(spark, sf_dir):
    """Uids that hold for a whole conversation, of made values."""
    made = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.when(F.col("role") == "user", "private_email").otherwise(F.col("role")).alias("label"), F.substring("text", 1, 3).alias("text"))
    return R.scoped_uids(made, ["conv_id"], ["turn"]).select("conv_id", "label", "text", "uid").distinct()


@query("mask_roundtrip", f"WITH {TEXTS_SQL} SELECT doc_id, md5(text) AS unmasked FROM texts")
def mask_roundtrip(spark, sf_dir):
    masked = R.mask(texts(spark, sf_dir)).select("doc_id", R.from_mask_json(R.mask_json(F.col("masked"))).alias("masked"))
    return masked.select("doc_id", F.md5(R.unmask_column(F.col("masked"))).alias("unmasked"))


def placed(text: str, spans: list[tuple[str, str]]) -> list[tuple[int, str, str, int, int]]:
    """(number, label, value, start, end) of spans that follow each other in a text."""
    out, at = [], 0
    for k, (label, value) in enumerate(spans):
        at = text.encode().index(value.encode(), at)
        out.append((k, label, value, at, at + len(value.encode())))
        at = out[-1][4]
    return out


_CASE_ROWS = [(i, *row) for i, (text, spans) in enumerate(CASES) for row in placed(text, spans)]


@query("scan_cases", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, '{label}', {quoted(v)}, {s}, {e})" for i, k, label, v, s, e in _CASE_ROWS) + ") v(case_id, span_no, label, value, start, \"end\")")
def scan_cases(spark, sf_dir):
    """All spans that the rules give for the examples: one too many shows as one too few does."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "case_id int, text string")
    return D.explode_spans(D.detect(df).drop("text")).select("case_id", "span_no", "label", F.col("text").alias("value"), "start", "end")


@query("detect_documents", f"{HITS_SQL} SELECT doc_id, lang, label, value AS text, true AS stands_there FROM hits")
def detect_documents(spark, sf_dir):
    spans = D.detect(texts(spark, sf_dir)).withColumnRenamed("text", "whole")
    found = spans.select("doc_id", "lang", "whole", F.explode("spans").alias("s"))
    return found.select("doc_id", "lang", "s.label", "s.text", (S.byte_slice(F.col("whole"), F.col("s.start"), F.col("s.end")) == F.col("s.text")).alias("stands_there"))


@query("detect_census", f"{HITS_SQL} SELECT lang, label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL")
def detect_census(spark, sf_dir):
    spans = D.explode_spans(D.detect(texts(spark, sf_dir).select("doc_id", "lang", "text")).drop("text"))
    return spans.groupBy("lang", "label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("redact_documents", f"WITH {TEXTS_SQL} SELECT doc_id, md5(replace({without_sql(_ORDER, put=chr(1))}, chr(1), '<REDACTED>')) AS redacted FROM texts")
def redact_documents(spark, sf_dir):
    return R.redact(texts(spark, sf_dir)).select("doc_id", F.md5("redacted").alias("redacted"))


@query("mask_documents", f"{HITS_SQL} SELECT doc_id, count(value) AS n_entities, count(DISTINCT label || ' ' || value) AS n_uids, false AS collides FROM texts LEFT JOIN hits USING (doc_id) GROUP BY doc_id")
def mask_documents(spark, sf_dir):
    entities = F.col("masked.entities")
    n_uids = F.size(F.array_distinct(F.transform(entities, lambda e: e["uid"])))
    return R.mask(texts(spark, sf_dir)).select("doc_id", F.size(entities).cast("bigint").alias("n_entities"), n_uids.cast("bigint").alias("n_uids"), R.collides(F.col("text")).alias("collides"))


#: Spans made from ids: five per document, some empty, some overlapping.
MADE_SQL = "made AS (SELECT doc_id, k AS ord, CAST((doc_id * 7 + k * 13) % 50 AS INT) AS s, CAST((doc_id * 7 + k * 13) % 50 + (doc_id + k * 5) % 17 AS INT) AS e FROM documents CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k))"


def made_spans(spark, sf_dir):
    made = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    start = (F.col("doc_id") * 7 + F.col("ord") * 13) % 50
    return made.select("doc_id", "ord", start.cast("int").alias("s"), (start + (F.col("doc_id") + F.col("ord") * 5) % 17).cast("int").alias("e"))


@query(
    "normalize_spans",
    f"""WITH RECURSIVE {MADE_SQL}, sorted AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, ord) AS n FROM made WHERE e > s),
    walk AS (SELECT doc_id, n, s, e, e AS last, true AS kept FROM sorted WHERE n = 1
      UNION ALL SELECT x.doc_id, x.n, x.s, x.e, CASE WHEN x.s >= w.last THEN x.e ELSE w.last END, x.s >= w.last FROM walk w JOIN sorted x ON x.doc_id = w.doc_id AND x.n = w.n + 1)
    SELECT doc_id, s AS start, e AS "end" FROM walk WHERE kept""",
)
def normalize_spans(spark, sf_dir):
    grouped = made_spans(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s", "e"))).alias("spans"))
    typed = F.transform("spans", lambda x: F.struct(F.lit("secret").alias("label"), x["s"].alias("start"), x["e"].alias("end")))
    return grouped.select("doc_id", F.explode(S.normalize_column(typed)).alias("x")).select("doc_id", "x.start", "x.end")


@query("span_overlap", f"WITH {MADE_SQL} SELECT a.doc_id, a.ord AS a, b.ord AS b FROM made a JOIN made b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.s < b.e AND a.e > b.s")
def span_overlap(spark, sf_dir):
    made = made_spans(spark, sf_dir)
    a, b = made.select("doc_id", F.col("ord").alias("a"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("x")), made.select("doc_id", F.col("ord").alias("b"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("y"))
    return a.join(b, "doc_id").where((F.col("a") < F.col("b")) & S.overlaps(F.col("x"), F.col("y"))).select("doc_id", "a", "b")


@query("span_containment", f"WITH {MADE_SQL} SELECT a.doc_id, a.ord AS \"outer\", b.ord AS \"inner\" FROM made a JOIN made b ON a.doc_id = b.doc_id AND a.ord <> b.ord AND a.s <= b.s AND a.e >= b.e")
def span_containment(spark, sf_dir):
    made = made_spans(spark, sf_dir)
    a, b = made.select("doc_id", F.col("ord").alias("outer"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("x")), made.select("doc_id", F.col("ord").alias("inner"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("y"))
    return a.join(b, "doc_id").where((F.col("outer") != F.col("inner")) & S.contains(F.col("x"), F.col("y"))).select("doc_id", "outer", "inner")


@query(
    "span_iou",
    f"""WITH {MADE_SQL} SELECT a.doc_id, a.ord AS a, b.ord AS b, round(CASE WHEN greatest(a.e, b.e) > least(a.s, b.s) THEN greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) / (greatest(a.e, b.e) - least(a.s, b.s)) ELSE 0 END, 6) AS iou
    FROM made a JOIN made b ON a.doc_id = b.doc_id AND a.ord < b.ord""",
)
def span_iou(spark, sf_dir):
    made = made_spans(spark, sf_dir)
    a = made.select("doc_id", F.col("ord").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = made.select("doc_id", F.col("ord").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, "doc_id").where("a < b").select("doc_id", "a", "b", F.round(S.iou(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")), 6).alias("iou"))


@query("lines", "SELECT doc_id, CAST(n AS INT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)")
def lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_ABBREVIATED = "(^|[^A-Za-z])(" + "|".join(ABBREVIATIONS) + r"|[A-Za-z])\.( [A-Z])"


@query(
    "segments",
    rf"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_ABBREVIATED}', '\1\2' || chr(1) || '\3', 'g'), '{_ABBREVIATED}', '\1\2' || chr(1) || '\3', 'g') AS t FROM documents WHERE text <> ''),
    b AS (SELECT doc_id, CASE WHEN strlen(text) < 256 THEN [text] ELSE list_filter(list_transform(string_split_regex(replace(regexp_replace(regexp_replace(t, '([?!]) ', '\1' || chr(2) || ' ', 'g'), '\.( [A-Z])', '.' || chr(2) || '\1', 'g'), chr(1), '.'), '[\x02\n\r]'),
      lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') END AS parts FROM a)
    SELECT doc_id, unnest(range(len(parts))) AS segment_no, unnest(parts) AS segment FROM b""",
)
def segments(spark, sf_dir):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans_of(values):
        return values.map(lambda t: [{"start": a, "end": b} for a, b in segment_spans((t or "").encode())])

    found = read(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(spans_of("text")).alias("segment_no", "x"))
    return found.select("doc_id", F.col("segment_no").cast("bigint").alias("segment_no"), S.byte_slice(F.col("text"), F.col("x.start"), F.col("x.end")).alias("segment"))


@query("byte_offsets", "SELECT doc_id, strpos(text, 'n') AS chars, strlen(left(text, CAST(strpos(text, 'n') AS BIGINT))) AS bytes, strlen(text) AS n_bytes FROM documents")
def byte_offsets(spark, sf_dir):
    at = F.instr("text", "n")
    return read(spark, sf_dir, "documents").select("doc_id", at.cast("bigint").alias("chars"), F.octet_length(F.substring(F.col("text"), F.lit(1), at)).cast("bigint").alias("bytes"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("byte_slice", "SELECT doc_id, left(text, 5) AS head FROM documents")
def byte_slice(spark, sf_dir):
    end = F.octet_length(F.substring("text", 1, 5))
    return read(spark, sf_dir, "documents").select("doc_id", S.byte_slice(F.col("text"), F.lit(0), end).alias("head"))


_TOKENS = [b"the", b"th", b"ing", b"in", b"lorem", b" a"]


@query("tokenize", "SELECT doc_id, n AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)lorem|the|ing|th|in| a|.')) AS n FROM documents) WHERE strlen(n) > 1 AND ascii(n) < 128 GROUP BY ALL")
def tokenize(spark, sf_dir):
    """Longest match over bytes: how often each token of several letters occurs in each text."""
    tokenizer = Tokenizer({bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(_TOKENS)})
    ids = token_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, output="ids").select("doc_id", F.explode(F.filter("ids", lambda i: i >= 256)).alias("id"))
    names = F.create_map(*[F.lit(x) for i, t in enumerate(_TOKENS) for x in (256 + i, t.decode())])
    return ids.groupBy("doc_id", names[F.col("id")].alias("token")).agg(F.count("*").alias("n"))


@query("token_cover", "SELECT doc_id, strlen(text) AS n_bytes, true AS covered FROM documents WHERE text IS NOT NULL")
def token_cover(spark, sf_dir):
    """Each token begins where the one before ends, from the first byte of a text to its last."""
    tokenizer = Tokenizer({bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(_TOKENS)})
    t = tokens(read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), tokenizer)
    zero = F.array(F.lit(0))
    meets = F.concat("tokens.start", F.array(F.octet_length("text"))) == F.concat(zero, "tokens.end")
    return t.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), meets.alias("covered"))


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, label FROM embeddings)"
DIMS = "d AS (SELECT vec_id, label, unnest(x) AS val, unnest(range(len(x))) AS dim FROM v)"
#: Vectors of 64 numbers stand for tokens, and weights follow from their places.
DIM = 64
SMALL = ModelConfig(hidden=DIM, intermediate=8, query_heads=2, kv_heads=1, head_dim=16, experts=6, top_k=2, window=3)


def made_weights(*shape: int, factors: tuple[int, ...], modulus: int) -> np.ndarray:
    """((sum of factor * index) % modulus - modulus // 2) / 10 at each place."""
    total = sum(f * i for f, i in zip(factors, np.indices(shape), strict=True))
    return (total % modulus - modulus // 2) / 10


def applied(spark, sf_dir, f) -> DataFrame:
    """(vec_id, dim, y) of an operator from (n, DIM) numbers to (n, k)."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        y = np.asarray(f(np.asarray(x.flatten()).reshape(-1, DIM)), dtype=np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))

    return vectors(spark, sf_dir).select("vec_id", F.posexplode(run("x")).alias("dim", "y")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("y", 5).alias("y"))


@query("rms_norm", f"WITH {VECTORS}, {DIMS}, m AS (SELECT vec_id, avg(val * val) AS ms FROM d GROUP BY vec_id) SELECT vec_id, dim, round(val / sqrt(ms + 1e-5) * (1 + dim / 64), 5) AS y FROM d JOIN m USING (vec_id)")
def rms_norm(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.rms_norm(x, 1 + np.arange(DIM) / DIM, 1e-5))


_W, _W_SQL = ((31, 17), 13), "((31 * o.o + 17 * dim) % 13 - 6) / 10"


@query("linear", f"WITH {VECTORS}, {DIMS} SELECT vec_id, o.o AS dim, round(sum(val * {_W_SQL}) + o.o / 10, 5) AS y FROM d, range(16) o(o) GROUP BY vec_id, o.o")
def linear(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.linear(x, made_weights(16, DIM, factors=_W[0], modulus=_W[1]), np.arange(16) / 10))


@query("softmax", f"WITH {VECTORS}, {DIMS} SELECT vec_id, dim, round(exp(4 * val) / sum(exp(4 * val)) OVER (PARTITION BY vec_id), 5) AS y FROM d")
def softmax(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.softmax(4 * x))


@query("top4_dims", f"WITH {VECTORS}, {DIMS} SELECT vec_id, rank - 1 AS dim, CAST(dim AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY val DESC, dim) AS rank FROM d) WHERE rank <= 4")
def top4_dims(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.top_k(x, 4))


_SWIGLU_SQL = "(greatest(-7, least(7, {up})) + 1) * least(7, {gate}) / (1 + exp(-1.702 * least(7, {gate})))"


@query("swiglu", f"WITH {VECTORS}, {DIMS} SELECT g.vec_id, g.dim, round({_SWIGLU_SQL.format(up='40 * u.val', gate='40 * g.val')}, 5) AS y FROM d g JOIN d u ON g.vec_id = u.vec_id AND u.dim = g.dim + 32")
def swiglu(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.swiglu(40 * x[:, :32], 40 * x[:, 32:], SMALL))


@query(
    "rope",
    f"""WITH {VECTORS}, {DIMS},
    f AS (SELECT i, power(150000, -2 * i / 16) AS base, least(1, greatest(0, (i - low) / (high - low))) AS ramp FROM range(8) r(i), (SELECT 8 * ln(4096 / (32 * 2 * pi())) / ln(150000) AS low, 8 * ln(4096 / (1 * 2 * pi())) / ln(150000) AS high)),
    a AS (SELECT e.vec_id, e.dim, e.val AS a, o.val AS b, (e.vec_id % 512) * (base / 32 * ramp + base * (1 - ramp)) AS angle, 0.1 * ln(32) + 1 AS strength FROM d e JOIN d o ON e.vec_id = o.vec_id AND o.dim = e.dim + 1 AND e.dim % 2 = 0 JOIN f ON f.i = (e.dim % 16) // 2)
    SELECT vec_id, dim, round((a * cos(angle) - b * sin(angle)) * strength, 5) AS y FROM a UNION ALL SELECT vec_id, dim + 1, round((b * cos(angle) + a * sin(angle)) * strength, 5) FROM a""",
)
def rope(spark, sf_dir):
    """Vectors as four heads of 16 numbers, at the position that the id gives."""

    @F.arrow_udf("array<double>")
    def run(ids: pa.Array, x: pa.Array) -> pa.Array:
        position = np.asarray(ids) % 512
        cos, sin = (t[position] for t in M.rope_tables(512, SMALL, np.float64))
        y = M.rotate(np.asarray(x.flatten()).reshape(-1, 4, 16), cos, sin).reshape(-1, DIM)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * DIM, pa.int32()), pa.array(y.ravel()))

    return vectors(spark, sf_dir).select("vec_id", F.posexplode(run("vec_id", "x")).alias("dim", "y")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("y", 5).alias("y"))


#: Vectors of 40 consecutive ids are the tokens of a sequence.
SEQUENCE = 40


def sequences(spark, sf_dir, f, kind: str) -> DataFrame:
    """f of the tokens of each sequence: from ids and (n, DIM) numbers in order to columns."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        return pa.table(f(np.asarray(t.column("vec_id")), np.stack(t.column("x").to_pylist())))

    return vectors(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / SEQUENCE)).groupBy("seq").applyInArrow(run, kind)


@query(
    "window_attention",
    f"""WITH {VECTORS}, {DIMS},
    s AS (SELECT q.vec_id, h.h, k.vec_id AS j, exp(sum(3 * q.val * k.val)) AS e FROM range(2) h(h), d q, d k WHERE q.dim // 16 = h.h AND k.dim = q.dim % 16 + 32 AND k.vec_id BETWEEN q.vec_id - 3 AND q.vec_id + 3 AND k.vec_id // {SEQUENCE} = q.vec_id // {SEQUENCE} GROUP BY ALL),
    z AS (SELECT vec_id, h, sum(e) + exp(CASE h WHEN 0 THEN 0.5 ELSE -0.25 END) AS z FROM s GROUP BY vec_id, h)
    SELECT s.vec_id, s.h * 16 + v.dim - 48 AS dim, round(sum(e * v.val) / any_value(z), 5) AS y FROM s JOIN z ON s.vec_id = z.vec_id AND s.h = z.h JOIN d v ON v.vec_id = j AND v.dim >= 48 GROUP BY ALL""",
)
def window_attention(spark, sf_dir):
    def run(ids, x):
        y = M.band_attention(3 * x[:, :32].reshape(-1, 2, 16), x[:, None, 32:48], x[:, None, 48:], np.array([0.5, -0.25]), SMALL.window)
        return {"vec_id": np.repeat(ids, 32), "dim": np.tile(np.arange(32), len(ids)), "y": y.ravel()}

    return sequences(spark, sf_dir, run, "vec_id bigint, dim bigint, y double").withColumn("y", F.round("y", 5))


#: Factors and modulus of the experts' weights, and the same in SQL.
EXPERT_WEIGHTS = {"mlp.router.weight": ((6, DIM), (5, 3), 11), "mlp.experts.gate_up_proj": ((6, DIM, 16), (7, 3, 5), 11), "mlp.experts.gate_up_proj_bias": ((6, 16), (3, 1), 5), "mlp.experts.down_proj": ((6, 8, DIM), (5, 3, 2), 7), "mlp.experts.down_proj_bias": ((6, DIM), (1, 1), 3)}
ROUTED = f"""{VECTORS}, {DIMS}, l AS (SELECT vec_id, e.e, sum(4 * val * ((5 * e.e + 3 * dim) % 11 - 5) / 10) AS logit FROM d, range(6) e(e) GROUP BY ALL),
    r AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS w FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, e) AS rank FROM l) WHERE rank <= 2)"""


def expert_weights() -> dict[str, np.ndarray]:
    return {name: made_weights(*shape, factors=factors, modulus=modulus) for name, (shape, factors, modulus) in EXPERT_WEIGHTS.items()}


@query("router_histogram", f"WITH {ROUTED} SELECT e AS expert, count(*) AS n FROM r GROUP BY e")
def router_histogram(spark, sf_dir):
    chosen = applied(spark, sf_dir, lambda x: M.routed(4 * x, expert_weights(), "mlp", SMALL)[0])
    return chosen.groupBy(F.col("y").cast("bigint").alias("expert")).agg(F.count("*").alias("n"))


@query("router_weights", f"WITH {ROUTED} SELECT vec_id, rank - 1 AS dim, round(w, 5) AS y FROM r")
def router_weights(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.routed(4 * x, expert_weights(), "mlp", SMALL)[1])


@query(
    "experts",
    f"""WITH {ROUTED},
    g AS (SELECT r.vec_id, r.e, w, j.j, sum(4 * val * ((7 * r.e + 3 * dim + 5 * j.j) % 11 - 5) / 10) + ((3 * r.e + j.j) % 5 - 2) / 10 AS y FROM r JOIN d USING (vec_id), range(16) j(j) GROUP BY r.vec_id, r.e, w, j.j),
    h AS (SELECT a.vec_id, a.e, a.w, a.j, {_SWIGLU_SQL.format(up='b.y', gate='a.y')} AS y FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.e = b.e AND b.j = a.j + 8),
    o AS (SELECT vec_id, e, w, o.o, sum(y * ((5 * e + 3 * j + 2 * o.o) % 7 - 3) / 10) + ((e + o.o) % 3 - 1) / 10 AS y FROM h, range(64) o(o) GROUP BY vec_id, e, w, o.o)
    SELECT vec_id, o AS dim, round(sum(w * y), 5) AS y FROM o GROUP BY vec_id, o""",
)
def experts(spark, sf_dir):
    return applied(spark, sf_dir, lambda x: M.experts(4 * x, expert_weights(), "mlp", SMALL))


_MOVES = [(a, b, allowed(a, b)) for a in range(N_TAGS) for b in range(N_TAGS)]


@query(
    "valid_transitions",
    """WITH t AS (SELECT c, CASE WHEN c = 0 THEN 'O' ELSE substr('BIES', (c - 1) % 4 + 1, 1) END AS b, (c + 3) // 4 AS l FROM (SELECT unnest(range(33)) AS c))
    SELECT p.c AS before, n.c AS after FROM t p CROSS JOIN t n WHERE CASE WHEN p.b IN ('O', 'E', 'S') THEN n.b IN ('O', 'B', 'S') ELSE n.b IN ('I', 'E') AND n.l = p.l END""",
)
def valid_transitions(spark, sf_dir):
    return spark.createDataFrame([(a, b, ok) for a, b, ok in _MOVES], "before bigint, after bigint, ok boolean").where("ok").drop("ok")


_BIAS = Calibration(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


@query(
    "transition_bias",
    """WITH t AS (SELECT c, CASE WHEN c = 0 THEN 'O' ELSE substr('BIES', (c - 1) % 4 + 1, 1) END AS b, (c + 3) // 4 AS l FROM (SELECT unnest(range(33)) AS c))
    SELECT p.c AS before, n.c AS after, CAST(CASE WHEN p.b = 'O' THEN CASE WHEN n.b = 'O' THEN 1 ELSE 2 END WHEN p.b IN ('B', 'I') THEN CASE WHEN n.b = 'I' THEN 3 ELSE 4 END WHEN n.b = 'O' THEN 5 ELSE 6 END AS DOUBLE) AS bias
    FROM t p CROSS JOIN t n WHERE CASE WHEN p.b IN ('O', 'E', 'S') THEN n.b IN ('O', 'B', 'S') ELSE n.b IN ('I', 'E') AND n.l = p.l END""",
)
def transition_biases(spark, sf_dir):
    return spark.createDataFrame([(a, b, transition_bias(a, b, _BIAS)) for a, b, ok in _MOVES if ok], "before bigint, after bigint, bias double")


@query("tag_names", "SELECT c AS tag, CASE WHEN c = 0 THEN 'O' ELSE substr('BIES', (c - 1) % 4 + 1, 1) || '-' || list_extract([" + ", ".join(f"'{x}'" for x in LABELS) + "], (c - 1) // 4 + 1) END AS name FROM (SELECT unnest(range(33)) AS c)")
def tag_names(spark, sf_dir):
    return spark.createDataFrame([(c, tag_name(c)) for c in range(N_TAGS)], "tag bigint, name string")


@query(
    "bioes_spans",
    f"""WITH {VECTORS}, {DIMS}, t AS (SELECT vec_id, dim, c, CASE WHEN c = 0 THEN 'O' ELSE substr('BIES', (c - 1) % 4 + 1, 1) END AS b, (c + 3) // 4 AS l FROM (SELECT vec_id, dim, CAST(floor(abs(val) * 997) AS BIGINT) % 9 AS c FROM d)),
    n AS (SELECT *, CASE WHEN b IN ('I', 'E') AND lag(b) OVER w IN ('B', 'I') AND lag(l) OVER w = l THEN 0 ELSE 1 END AS fresh, lead(b) OVER w AS next_b, lead(l) OVER w AS next_l FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY dim)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY dim) AS island FROM n WHERE b <> 'O'),
    s AS (SELECT vec_id, island, any_value(l) AS l, min(dim) AS start, max(dim) + 1 AS "end", arg_max(b, dim) AS last_b, arg_max(next_b, dim) AS next_b, arg_max(next_l, dim) AS next_l FROM i GROUP BY ALL)
    SELECT vec_id, start, "end", CASE l WHEN 1 THEN '{LABELS[0]}' ELSE '{LABELS[1]}' END AS label FROM s WHERE NOT (last_b IN ('B', 'I') AND coalesce(next_b, 'O') IN ('I', 'E') AND next_l <> l)""",
)
def bioes_spans(spark, sf_dir):
    """Spans of any tags, followed or not by what may follow them."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint,label:string>>")
    def spans(values):
        places = [(0, i, i + 1) for i in range(DIM)]
        return values.map(lambda x: [{"start": a, "end": b, "label": label} for a, b, label in tag_spans(places, np.floor(np.abs(np.asarray(x)) * 997).astype(np.int64) % 9)])

    return vectors(spark, sf_dir).select("vec_id", F.explode(spans("x")).alias("s")).select("vec_id", "s.*")


_CALIBRATION = Calibration(0.25, -0.25, 0.125, -0.125, 0.5, -0.5)


@query(
    "viterbi_spans",
    f"""WITH RECURSIVE {VECTORS}, {DIMS},
    t AS (SELECT c, CASE WHEN c = 0 THEN 'O' ELSE substr('BIES', (c - 1) % 4 + 1, 1) END AS b, (c + 3) // 4 AS l FROM (SELECT unnest(range(33)) AS c)),
    m AS (SELECT p.c AS before, n.c AS after, CASE WHEN p.b = 'O' THEN CASE WHEN n.b = 'O' THEN 0.25 ELSE -0.25 END WHEN p.b IN ('B', 'I') THEN CASE WHEN n.b = 'I' THEN 0.125 ELSE -0.125 END WHEN n.b = 'O' THEN 0.5 ELSE -0.5 END AS bias
      FROM t p, t n WHERE CASE WHEN p.b IN ('O', 'E', 'S') THEN n.b IN ('O', 'B', 'S') ELSE n.b IN ('I', 'E') AND n.l = p.l END),
    e AS (SELECT a.vec_id // {SEQUENCE} AS seq, a.vec_id % {SEQUENCE} AS pos, a.dim AS c, 8 * (a.val + b.val) AS score FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim < 33 AND b.dim = a.dim + 31),
    w AS (SELECT seq, 0 AS pos, e.c, score AS best, [e.c] AS path FROM e JOIN t USING (c) WHERE pos = 0 AND b IN ('O', 'B', 'S')
      UNION ALL SELECT w.seq, w.pos + 1, e.c, max(w.best + bias) + any_value(score), list_append(arg_max(w.path, w.best + bias), e.c) FROM w JOIN m ON m.before = w.c JOIN e ON e.seq = w.seq AND e.pos = w.pos + 1 AND e.c = m.after GROUP BY w.seq, w.pos, e.c),
    p AS (SELECT seq, arg_max(path, best) AS path FROM w JOIN t USING (c) WHERE b IN ('O', 'E', 'S') AND pos = (SELECT max(pos) FROM e WHERE e.seq = w.seq) GROUP BY seq),
    u AS (SELECT seq, unnest(path) AS c, unnest(range(len(path))) AS pos FROM p),
    x AS (SELECT seq, pos, b, l, sum(CASE WHEN b IN ('B', 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos) AS island FROM u JOIN t USING (c))
    SELECT seq, min(pos) AS start, max(pos) + 1 AS "end", list_extract([{", ".join(f"'{x}'" for x in LABELS)}], any_value(l)) AS label FROM x WHERE b <> 'O' GROUP BY seq, island""",
)
def viterbi_spans(spark, sf_dir):
    def run(ids, x):
        tags = viterbi(8 * (x[:, :33] + x[:, 31:]), _CALIBRATION)
        spans = tag_spans([(0, i, i + 1) for i in range(len(ids))], tags)
        columns = list(zip(*spans, strict=True)) or [(), (), ()]
        return {"seq": pa.array([ids[0] // SEQUENCE] * len(spans), pa.int64()), "start": pa.array(columns[0], pa.int64()), "end": pa.array(columns[1], pa.int64()), "label": pa.array(columns[2], pa.string())}

    return sequences(spark, sf_dir, run, "seq bigint, start bigint, `end` bigint, label string")


def score_digests(texts: list[str | None], weights, c: ModelConfig) -> list[tuple[int, list[float], str]]:
    """Of the tag scores of all bytes of each text, segment by segment as the engine sees them: how many, their sums, and the SHA-256 of the best tags (a byte each)."""
    owner, segments = [], []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for span in segment_spans(b):
            owner.append(i), segments.append(segment_bytes(b, span))
    n, sums, best = [0] * len(texts), np.zeros((len(texts), c.labels)), [hashlib.sha256() for _ in texts]
    lengths = np.array([len(x) for x in segments], dtype=np.int64)
    for first, last in M.blocks(lengths):
        scores = M.forward_joined(np.frombuffer(b"".join(segments[first:last]), dtype=np.uint8), lengths[first:last], weights, c)
        tags, at = M.best_tags(scores), 0
        ends = np.cumsum(lengths[first:last])
        for k in range(first, last):
            if k + 1 == last or owner[k + 1] != owner[k]:
                to, i = int(ends[k - first]), owner[k]
                n[i] += to - at
                sums[i] += scores[at:to].sum(axis=0, dtype=np.float64)
                best[i].update(tags[at:to].tobytes())
                at = to
    return [(k, row.round(3).tolist(), digest.hexdigest()) for k, row, digest in zip(n, sums, best, strict=True)]


@query("forward_scores")
def forward_scores(spark, sf_dir):
    c = ModelConfig(hidden=16, intermediate=8, layers=2, query_heads=4, kv_heads=2, head_dim=4, experts=6, top_k=2, window=3, vocab=256, pad_id=255)
    weights = spark.sparkContext.broadcast(M.random_weights(c))

    @F.pandas_udf("struct<n_tokens:bigint,scores:array<double>,tags_sha256:string>")
    def digest(values):
        texts, rows, at = values.tolist(), [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < D.TOGETHER):
                size += len(texts[to] or "")
                to += 1
            rows += score_digests(texts[at:to], weights.value, c)
            at = to
        return pd.DataFrame(rows, columns=["n_tokens", "scores", "tags_sha256"])

    return read(spark, sf_dir, "documents").select("doc_id", digest("text").alias("x")).select("doc_id", "x.*")


TRUTH_SQL = f"""{MADE_SQL}, truth AS (SELECT m.doc_id, ord AS span_no, CASE ord WHEN 0 THEN 'secret' ELSE 'private_date' END AS label, lang, 100 * CAST(ord AS INT) + s AS start, 100 * CAST(ord AS INT) + s + 10 AS "end" FROM made m JOIN documents USING (doc_id)),
  predicted AS (SELECT m.doc_id, ord AS span_no, CASE ord WHEN 0 THEN 'secret' ELSE 'private_date' END AS label, lang, 100 * CAST(ord AS INT) + s + CAST((m.doc_id + ord) % 6 AS INT) AS start, 100 * CAST(ord AS INT) + s + 10 + CAST((m.doc_id + ord) % 6 AS INT) AS "end" FROM made m JOIN documents USING (doc_id) WHERE (m.doc_id + ord) % 7 > 0),
  pairs AS (SELECT t.doc_id, t.span_no AS t, p.span_no AS p FROM truth t JOIN predicted p ON t.doc_id = p.doc_id AND t.label = p.label AND greatest(least(t."end", p."end") - greatest(t.start, p.start), 0) >= 0.5 * (greatest(t."end", p."end") - least(t.start, p.start))),
  counted AS (SELECT label, lang, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS tp, 0 AS fp, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS fn FROM truth LEFT JOIN pairs ON truth.doc_id = pairs.doc_id AND span_no = t
    UNION ALL SELECT label, lang, 0, CASE WHEN t IS NULL THEN 1 ELSE 0 END, 0 FROM predicted LEFT JOIN pairs ON predicted.doc_id = pairs.doc_id AND span_no = p)"""


def rates_sql(by: str) -> str:
    return f"""WITH {TRUTH_SQL}, sums AS (SELECT {by}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counted GROUP BY {by}), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM sums)
    SELECT {by}, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM r"""


def truth_and_predicted(spark, sf_dir):
    made = made_spans(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    label = F.when(F.col("ord") == 0, "secret").otherwise("private_date")
    start = 100 * F.col("ord") + F.col("s")
    off = ((F.col("doc_id") + F.col("ord")) % 6).cast("int")
    truth = made.select("doc_id", F.col("ord").alias("span_no"), label.alias("label"), "lang", start.alias("start"), (start + 10).alias("end"))
    predicted = made.where((F.col("doc_id") + F.col("ord")) % 7 > 0).select("doc_id", F.col("ord").alias("span_no"), label.alias("label"), "lang", (start + off).alias("start"), (start + 10 + off).alias("end"))
    return truth, predicted


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("prf_by_label", rates_sql("label"))
def prf_by_label(spark, sf_dir):
    return _rounded(E.evaluate(*truth_and_predicted(spark, sf_dir), by=["label"]))


@query("prf_by_lang", rates_sql("lang"))
def prf_by_lang(spark, sf_dir):
    return _rounded(E.evaluate(*truth_and_predicted(spark, sf_dir), by=["lang"]))


@query("model_vs_rules", f"SELECT label, CASE label WHEN 'secret' THEN f1 ELSE 0 END AS first_f1, f1 AS second_f1, CASE label WHEN 'secret' THEN 0.0 ELSE f1 END AS gain FROM ({rates_sql('label')})")
def model_vs_rules(spark, sf_dir):
    truth, predicted = truth_and_predicted(spark, sf_dir)
    both = E.compare(E.evaluate(truth, predicted.where("label = 'secret'"), by=["label"]), E.evaluate(truth, predicted, by=["label"]), ["label"])
    return both.withColumns({c: F.round(c, 6) for c in ("first_f1", "second_f1", "gain")})


@query("generated_mixture", "SELECT * FROM (VALUES ('en', 325), ('cn', 29), ('jp', 29), ('kr', 29), ('de', 29), ('fr', 29), ('es', 29)) v(lang, n)")
def generated_mixture(spark, sf_dir):
    return synth.generate(spark, 500).groupBy("lang").agg(F.count("*").cast("int").alias("n"))


@query("generated_truth", "SELECT CAST(499 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_wrong")
def generated_truth(spark, sf_dir):
    samples = synth.generate(spark, 500)
    wrong = F.exists("spans", lambda s: S.byte_slice(F.col("text"), s["start"], s["end"]) != s["text"])
    return samples.agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"))


@query("rules_on_generated")
def rules_on_generated(spark, sf_dir):
    samples = synth.generate(spark, 500)
    predicted = D.explode_spans(D.detect(samples.select("doc_id", "lang", "text")).drop("text"))
    truth = samples.select("doc_id", "lang", F.posexplode("spans").alias("span_no", "s")).select("doc_id", "lang", "span_no", "s.label", "s.start", "s.end")
    return E.evaluate(truth, predicted.select("doc_id", "lang", "span_no", "label", "start", "end"), by=["label"])
