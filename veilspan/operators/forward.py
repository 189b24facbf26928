"""The span model's forward pass in numpy: mixture-of-experts transformer with banded attention over the tokens of one segment.

Small models hold a feature's numbers of all tokens side by side (arrays in Fortran order), so that each operation runs along the tokens;
large ones hold the numbers of a token side by side. Operators keep the order that they are given.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np

from ..config import ModelConfig

Weights = Mapping[str, np.ndarray]


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    y = x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + np.float32(eps))
    return np.multiply(y, weight, out=y if np.result_type(y, weight) == y.dtype else None)


def by_feature(x: np.ndarray) -> bool:
    """Whether a feature's numbers lie side by side."""
    return x.flags.f_contiguous and not x.flags.c_contiguous


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """weight is (out, in)."""
    y = (weight @ x.T).T if by_feature(x) else x @ weight.T
    return y if bias is None else np.add(y, bias, out=y if np.result_type(y, bias) == y.dtype else None)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -88, 88)
    np.negative(y, out=y)
    np.exp(y, out=y)
    y += 1
    return np.divide(1, y, out=y)


def top_k(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest of each row, of equal ones the lower index first; NaN is an error."""
    if x.size and np.isnan(x.min()):
        raise ValueError("router logits are not numbers")
    if by_feature(x) and x.ndim == 2 and x.shape[1] <= FEW:
        return _few_top_k(x, k)
    return np.argsort(-x, axis=-1, kind="stable")[..., :k]


#: Up to so many columns are ranked by comparing each with each.
FEW = 12


def _few_top_k(x: np.ndarray, k: int) -> np.ndarray:
    """top_k() by the number of larger columns, or equal ones before."""
    columns = x.T
    rank = np.zeros(columns.shape, dtype=np.int8)
    for i in range(len(columns)):
        for j in range(i):
            less = columns[j] < columns[i]
            rank[j] += less
            rank[i] += ~less
    out = np.zeros((min(k, len(columns)), len(x)), dtype=np.int8)
    for place, row in enumerate(out):
        for i in range(1, len(columns)):
            row += (rank[i] == place).view(np.int8) * np.int8(i)
    return out.astype(np.intp).T


def rope_tables(n: int, c: ModelConfig, dtype=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines (n, head_dim / 2), with frequencies stretched between two bounds of their rotations and a concentration factor."""
    half = c.head_dim // 2
    i = np.arange(half)
    frequency = c.rope_theta ** (-2 * i / c.head_dim)
    bound = lambda rotations: half * np.log(c.rope_original / (rotations * 2 * np.pi)) / np.log(c.rope_theta)
    low, high = bound(c.rope_beta_fast), bound(c.rope_beta_slow)
    ramp = np.clip((i - low) / (high - low), 0, 1)
    frequency = frequency / c.rope_factor * ramp + frequency * (1 - ramp)
    angle = np.arange(n)[:, None] * frequency
    strength = 0.1 * np.log(c.rope_factor) + 1
    return (np.cos(angle) * strength).astype(dtype), (np.sin(angle) * strength).astype(dtype)


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """x (n, heads, head_dim), neighbouring numbers as pairs."""
    a, b = x[..., 0::2], x[..., 1::2]
    cos, sin = cos[:, None], sin[:, None]  # the same for all heads
    out = np.empty_like(x)
    out[..., 0::2], out[..., 1::2] = a * cos - b * sin, b * cos + a * sin
    return out


#: Tokens whose scores are laid out at a time, at least.
ATTENTION_ROWS = 32


def band_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, sinks: np.ndarray, window: int, segment: np.ndarray | None = None) -> np.ndarray:
    """q (n, query heads, d), k and v (n, kv heads, d): attention to tokens at most window away and, if segments are given, of the same one; a head's sink joins the denominator alone."""
    n, heads, d = q.shape
    group = heads // k.shape[1]
    if 2 * window < FEW:
        return _narrow_attention(q, k, v, sinks, window, np.zeros(n, dtype=np.int64) if segment is None else segment)
    out = np.empty_like(q)
    step = max(2 * window, ATTENTION_ROWS)
    keys, values = k.transpose(1, 2, 0), v.transpose(1, 0, 2)  # (kv heads, d, n), (kv heads, n, d)
    for at in range(0, n, step):
        rows = slice(at, min(n, at + step))
        cols = slice(max(0, rows.start - window), min(n, rows.stop + window))
        far = np.abs(np.arange(rows.start, rows.stop)[:, None] - np.arange(cols.start, cols.stop)[None]) > window
        if segment is not None:
            far |= segment[rows, None] != segment[None, cols]
        own = q[rows].transpose(1, 0, 2).reshape(k.shape[1], group * (rows.stop - rows.start), d)  # heads that share keys stand together
        scores = (own @ keys[:, :, cols]).reshape(heads, rows.stop - rows.start, -1)
        scores[:, far] = -np.inf
        sink = sinks[:, None, None]
        top = np.maximum(scores.max(axis=2, keepdims=True), sink)
        e = np.exp(scores - top)
        mixed = (e.reshape(k.shape[1], -1, e.shape[2]) @ values[:, cols]).reshape(heads, -1, d)
        out[rows] = (mixed / (e.sum(axis=2, keepdims=True) + np.exp(sink - top))).transpose(1, 0, 2)
    return out


#: Tokens that a narrow band is laid out for at a time.
NARROW_ROWS = 4096


def _narrow_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, sinks: np.ndarray, window: int, segment: np.ndarray) -> np.ndarray:
    """band_attention() with a row of scores for each distance, along the tokens."""
    (n, heads, d), kv = q.shape, k.shape[1]
    out = np.empty((heads, d, n), dtype=q.dtype).transpose(2, 0, 1)
    sink = sinks.reshape(kv, heads // kv, 1).astype(q.dtype)
    for at in range(0, n, NARROW_ROWS):
        m = min(NARROW_ROWS, n - at)
        first, last = max(0, at - window), min(n, at + m + window)
        near = slice(first - at + window, last - at + window)
        keys, values = np.zeros((kv, 1, d, m + 2 * window), dtype=k.dtype), np.zeros((kv, 1, d, m + 2 * window), dtype=v.dtype)
        keys[:, 0, :, near], values[:, 0, :, near] = k[first:last].transpose(1, 2, 0), v[first:last].transpose(1, 2, 0)
        place = np.full(m + 2 * window, -1, dtype=segment.dtype)
        place[near] = segment[first:last]
        own = np.ascontiguousarray(q[at : at + m].transpose(1, 2, 0)).reshape(kv, -1, d, m)
        scores, products = np.empty((2 * window + 1, *own.shape[:2], m), dtype=q.dtype), np.empty_like(own)
        for i, row in enumerate(scores):
            np.multiply(own, keys[..., i : i + m], out=products)
            products.sum(axis=2, out=row)
            if i != window:
                far = np.flatnonzero(place[window : window + m] != place[i : i + m])
                row[..., far] = -np.inf
        top = np.maximum(scores.max(axis=0), sink)
        scores -= top
        np.exp(scores, out=scores)
        mixed = scores[0][:, :, None] * values[..., :m]
        for i in range(1, len(scores)):
            mixed += np.multiply(scores[i][:, :, None], values[..., i : i + m], out=products)
        mixed /= (scores.sum(axis=0) + np.exp(sink - top))[:, :, None]
        out[at : at + m] = mixed.reshape(heads, d, m).transpose(2, 0, 1)
    return out


def swiglu(gate: np.ndarray, up: np.ndarray, c: ModelConfig) -> np.ndarray:
    gate, up = np.minimum(gate, c.swiglu_limit), np.clip(up, -c.swiglu_limit, c.swiglu_limit)
    up += 1
    up *= gate
    up *= sigmoid(c.swiglu_alpha * gate)
    return up


def best_tags(scores: np.ndarray) -> np.ndarray:
    """The tag with the highest score of each token, of equal ones the lower; up to 256 tags."""
    if not by_feature(scores):
        return scores.argmax(axis=1).astype(np.uint8)
    top, best = scores[:, 0].copy(), np.zeros(len(scores), dtype=np.uint8)
    for tag in range(1, scores.shape[1]):
        np.maximum(best, (scores[:, tag] > top).view(np.uint8) * np.uint8(tag), out=best)
        np.maximum(top, scores[:, tag], out=top)
    return best


def _rows(w: Weights, name: str, index) -> np.ndarray:
    """Part of a tensor along its first axis; a mapped file decodes no more than that."""
    part = getattr(w, "rows", None)
    return part(name, index) if part else w[name][index]


def routed(x: np.ndarray, w: Weights, prefix: str, c: ModelConfig) -> tuple[np.ndarray, np.ndarray]:
    """Each token's top experts, and their weights: the softmax of their logits."""
    logits = linear(x, w[f"{prefix}.router.weight"], w.get(f"{prefix}.router.bias"))
    chosen = top_k(logits, c.top_k)
    return chosen, softmax(np.take_along_axis(logits, chosen, axis=1))


def experts(x: np.ndarray, w: Weights, prefix: str, c: ModelConfig) -> np.ndarray:
    """The weighted sum of each token's top experts; tokens are grouped by expert so that each product is dense and each expert is read once."""
    chosen, weights = routed(x, w, prefix, c)
    flat = chosen.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=c.experts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if by_feature(x):
        return _experts_by_feature(x, weights.ravel()[order], order, ends, w, prefix, c)
    out = np.zeros_like(x)
    for e in np.flatnonzero(counts):
        pairs = order[ends[e] : ends[e + 1]]
        token = pairs // c.top_k
        part = lambda name: _rows(w, f"{prefix}.experts.{name}", int(e))  # noqa: E731, B023
        both = x[token] @ part("gate_up_proj") + part("gate_up_proj_bias")
        half = both.shape[1] // 2
        out[token] += (swiglu(both[:, :half], both[:, half:], c) @ part("down_proj") + part("down_proj_bias")) * weights.ravel()[pairs, None]
    return out


def _experts_by_feature(x: np.ndarray, weights: np.ndarray, order: np.ndarray, ends: np.ndarray, w: Weights, prefix: str, c: ModelConfig) -> np.ndarray:
    """experts() of pairs of token and expert, sorted by expert."""
    given = x.T.take(order // c.top_k, axis=1)
    for e in np.flatnonzero(np.diff(ends)):
        own = slice(ends[e], ends[e + 1])
        part = lambda name: _rows(w, f"{prefix}.experts.{name}", int(e))  # noqa: E731, B023
        both = part("gate_up_proj").T @ given[:, own] + part("gate_up_proj_bias")[:, None]
        half = len(both) // 2
        y = part("down_proj").T @ swiglu(both[:half], both[half:], c)
        y += part("down_proj_bias")[:, None]
        y *= weights[own]
        given[:, own] = y
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = given.take(back[:: c.top_k], axis=1)
    for k in range(1, c.top_k):
        out += given.take(back[k :: c.top_k], axis=1)
    return out.T


def attention(x: np.ndarray, w: Weights, prefix: str, c: ModelConfig, tables: tuple[np.ndarray, np.ndarray], segment: np.ndarray | None = None) -> np.ndarray:
    """tables are those of rope_tables() at the tokens' places, times head_dim ** -0.25."""
    n = len(x)
    project = lambda name, heads: linear(x, w[f"{prefix}.{name}_proj.weight"], w.get(f"{prefix}.{name}_proj.bias")).reshape(n, heads, c.head_dim)
    q, k = rotate(project("q", c.query_heads), *tables), rotate(project("k", c.kv_heads), *tables)
    mixed = band_attention(q, k, project("v", c.kv_heads), w[f"{prefix}.sinks"], c.window, segment)
    return linear(mixed.reshape(n, -1), w[f"{prefix}.o_proj.weight"], w.get(f"{prefix}.o_proj.bias"))


def forward(ids: np.ndarray, w: Weights, c: ModelConfig) -> np.ndarray:
    """Tag scores (tokens, labels) of the token ids of one segment; ids out of range count as padding."""
    return forward_many([ids], w, c)[0]


def forward_many(segments: list[np.ndarray], w: Weights, c: ModelConfig) -> list[np.ndarray]:
    """forward() of each segment; all tokens pass a layer together, so its tensors are read once for all."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    scores = forward_joined(np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(s, dtype=np.int64) for s in segments)]), lengths, w, c)
    return np.split(scores, np.cumsum(lengths)[:-1])


#: Models up to this width are small.
SMALL_HIDDEN = 64


#: Tokens that pass a small model together, so that they stay in the processor's cache.
BLOCK_TOKENS = 1 << 13


def blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of segments of at most about BLOCK_TOKENS tokens; a longer segment stands alone."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_TOKENS, side="right")))
        yield first, last
        first = last


def forward_joined(ids: np.ndarray, lengths: np.ndarray, w: Weights, c: ModelConfig) -> np.ndarray:
    """Tag scores of the tokens of segments that follow each other, with the lengths of the segments."""
    if not len(ids):
        return np.zeros((0, c.labels), dtype=np.float32)
    if hasattr(w, "rows"):
        size = w.shape("model.embed_tokens.weight")[0]
        used, place = np.unique(np.where((ids < 0) | (ids >= size), c.pad_id, ids), return_inverse=True)
        x = np.asarray(_rows(w, "model.embed_tokens.weight", used), dtype=np.float32)[place]
    else:
        table = np.asarray(w["model.embed_tokens.weight"], dtype=np.float32)
        x = table[np.where((ids < 0) | (ids >= len(table)), c.pad_id, ids)]
    order = "F" if c.hidden <= SMALL_HIDDEN and 2 * c.window < FEW else "C"
    x = np.asarray(x, order=order)
    segment = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    position = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tables = tuple(np.asarray(t[position], order=order) for t in rope_tables(int(lengths.max()), c))
    tables = tuple(t * np.float32(c.head_dim**-0.25) for t in tables)
    for layer in range(c.layers):
        p = f"model.layers.{layer}"
        x = x + attention(rms_norm(x, w[f"{p}.input_layernorm.weight"], c.eps), w, f"{p}.self_attn", c, tables, segment if len(lengths) > 1 else None)
        x = x + experts(rms_norm(x, w[f"{p}.post_attention_layernorm.weight"], c.eps), w, f"{p}.mlp", c)
    return linear(rms_norm(x, w["model.norm.weight"], c.eps), w["score.weight"], w.get("score.bias"))


def random_weights(c: ModelConfig, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights of the right shapes, for tests."""
    r = np.random.default_rng(seed)
    draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
    out = {"model.embed_tokens.weight": draw(c.vocab, c.hidden), "model.norm.weight": draw(c.hidden) + 1, "score.weight": draw(c.labels, c.hidden), "score.bias": draw(c.labels)}
    for layer in range(c.layers):
        p = f"model.layers.{layer}"
        out |= {f"{p}.input_layernorm.weight": draw(c.hidden) + 1, f"{p}.post_attention_layernorm.weight": draw(c.hidden) + 1}
        for name, heads in (("q", c.query_heads), ("k", c.kv_heads), ("v", c.kv_heads)):
            out |= {f"{p}.self_attn.{name}_proj.weight": draw(heads * c.head_dim, c.hidden), f"{p}.self_attn.{name}_proj.bias": draw(heads * c.head_dim)}
        out |= {f"{p}.self_attn.o_proj.weight": draw(c.hidden, c.query_heads * c.head_dim), f"{p}.self_attn.o_proj.bias": draw(c.hidden), f"{p}.self_attn.sinks": draw(c.query_heads)}
        out |= {f"{p}.mlp.router.weight": draw(c.experts, c.hidden), f"{p}.mlp.router.bias": draw(c.experts)}
        out |= {f"{p}.mlp.experts.gate_up_proj": draw(c.experts, c.hidden, 2 * c.intermediate), f"{p}.mlp.experts.gate_up_proj_bias": draw(c.experts, 2 * c.intermediate)}
        out |= {f"{p}.mlp.experts.down_proj": draw(c.experts, c.intermediate, c.hidden), f"{p}.mlp.experts.down_proj_bias": draw(c.experts, c.hidden)}
    return out
