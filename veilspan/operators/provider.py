"""Span providers: none, fixed spans, and the sequence-labelling model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from ..config import Calibration, ModelConfig
from ..sources.safetensors import TensorFile
from .forward import forward_many
from .spans import Span, trimmed
from .tokenizer import Tokenizer
from .viterbi import tag_spans, viterbi


def phrase_provider(phrases: dict[str, str]):
    """Every occurrence of each phrase, with its label; for tests and dictionaries."""
    known = [(p.encode(), label) for p, label in phrases.items() if p]

    def spans(b: bytes) -> Sequence[Span]:
        out = []
        for phrase, label in known:
            at = b.find(phrase)
            while at >= 0:
                out.append((at, at + len(phrase), label))
                at = b.find(phrase, at + len(phrase))
        return sorted(out)

    return spans


@lru_cache(maxsize=1)
def _weights(path: str) -> TensorFile:
    """One mapping of the weights per worker process."""
    return TensorFile(path)


class ModelProvider:
    """Tokens of a segment, tag scores, the best path, spans. Only paths and small parts travel to the workers."""

    def __init__(self, weights_path: str, tokenizer: Tokenizer, config: ModelConfig = ModelConfig(), calibration: Calibration = Calibration()):
        self.weights_path, self.tokenizer, self.config, self.calibration = weights_path, tokenizer, config, calibration

    def many(self, segments: Sequence[bytes]) -> list[Sequence[Span]]:
        """Spans of each segment. All pass the model together."""
        tokens = [self.tokenizer(b) for b in segments]
        scores = forward_many([np.array([t[0] for t in x], dtype=np.int64) for x in tokens], _weights(self.weights_path), self.config)
        out = []
        for b, x, s in zip(segments, tokens, scores, strict=True):
            spans = (trimmed(b, span) for span in tag_spans(x, viterbi(s, self.calibration)))
            out.append([span for span in spans if span[1] > span[0]])
        return out

    def __call__(self, b: bytes) -> Sequence[Span]:
        return self.many([b])[0]
