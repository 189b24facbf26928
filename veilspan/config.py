"""Labels, tag set, model dimensions and calibration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

# Label names in tag order, and their placeholder prefixes.
LABELS = ["account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret"]
PREFIXES = {
    "account_number": "ACCOUNT",
    "private_address": "ADDRESS",
    "private_date": "DATE",
    "private_email": "EMAIL",
    "private_person": "PERSON",
    "private_phone": "PHONE",
    "private_url": "URL",
    "secret": "SECRET",
}
OTHER_PREFIX = "PII"
BOUNDARIES = "BIES"
#: Class 0 is outside; class c > 0 is boundary (c - 1) % 4 of label (c - 1) // 4.
N_TAGS = 1 + len(LABELS) * len(BOUNDARIES)


def tag_name(c: int) -> str:
    return "O" if c == 0 else f"{BOUNDARIES[(c - 1) % 4]}-{LABELS[(c - 1) // 4]}"


@dataclass(frozen=True)
class ModelConfig:
    """Dimensions of the span model; tests use small ones."""

    hidden: int = 640
    intermediate: int = 640
    layers: int = 8
    query_heads: int = 14
    kv_heads: int = 2
    head_dim: int = 64
    experts: int = 128
    top_k: int = 4
    labels: int = N_TAGS
    window: int = 128
    vocab: int = 200064
    pad_id: int = 199999
    rope_theta: float = 150000.0
    rope_factor: float = 32.0
    rope_original: int = 4096
    rope_beta_fast: float = 32.0
    rope_beta_slow: float = 1.0
    eps: float = 1e-5
    swiglu_alpha: float = 1.702
    swiglu_limit: float = 7.0


@dataclass(frozen=True)
class Calibration:
    """Biases of tag transitions."""

    background_stay: float = 0.0
    background_to_start: float = 0.0
    inside_to_continue: float = 0.0
    inside_to_end: float = 0.0
    end_to_background: float = 0.0
    end_to_start: float = 0.0

    @classmethod
    def load(cls, path: str | Path) -> Calibration:
        """From a JSON object of `transition_bias_*` numbers, anywhere in it; a missing file or key is 0, another value an error."""
        if not Path(path).exists():
            return cls()
        found: dict[str, float] = {}

        def walk(node):
            if isinstance(node, dict):
                for key, value in node.items():
                    name = key.removeprefix("transition_bias_")
                    if name != key and name in {f.name for f in fields(cls)} and name not in found:
                        if isinstance(value, bool) or not isinstance(value, (int, float)):
                            raise ValueError(f"{key} is not a number")
                        found[name] = float(value)
                    walk(value)
            elif isinstance(node, list):
                for value in node:
                    walk(value)

        walk(json.loads(Path(path).read_text()))
        return cls(**found)


MODEL_FILES = ("tokenizer.json", "model.safetensors")


def model_ready(path: Path) -> bool:
    return all((path / name).is_file() for name in MODEL_FILES)


def resolve_model_dir(explicit: str | None = None, variables: tuple[str, ...] = ("VEILSPAN_MODEL",), folders: tuple[str, ...] = ("model", "models/default")) -> Path | None:
    """The model's folder: as given, from the environment, below the working folder, or in the user's cache; None without one. Every choice is checked."""
    choices = [Path(explicit)] if explicit else [Path(os.environ[v]) for v in variables if os.environ.get(v)]
    if not explicit:
        choices += [Path(f) for f in folders] + [Path.home() / ".cache" / "veilspan"]
    for path in choices:
        if model_ready(path):
            return path
    if explicit:
        raise FileNotFoundError(f"{explicit} lacks {' or '.join(MODEL_FILES)}")
    return None
