"""Command line: detect, redact, mask, unmask and tokens over an argument, a file or standard input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import config
from .operators import detect as D
from .operators import render as R
from .operators.provider import ModelProvider
from .operators.tokenizer import tokens
from .sources.files import read_tokenizer, text_frame


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("veilspan", description=__doc__)
    p.add_argument("mode", choices=["detect", "redact", "mask", "unmask", "tokens"], nargs="?", default="detect")
    p.add_argument("text", nargs="*", help="the last one counts; none: standard input")
    p.add_argument("--file")
    p.add_argument("--model", help="folder of tokenizer.json and model.safetensors")
    p.add_argument("--no-rules", action="store_true", help="for detect")
    p.add_argument("--version", action="version", version="veilspan 1")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    text = open(args.file, encoding="utf-8").read() if args.file else args.text[-1] if args.text else sys.stdin.read()
    if args.mode == "unmask":
        found = json.loads(text)
        return R.unmask_text(found["masked_text"], [(e["uid"], e["label"], e["text"]) for e in found["entities"]])
    folder = config.resolve_model_dir(args.model)
    provider = tokenizer = None
    if folder:
        tokenizer = read_tokenizer(spark, f"file://{(folder / 'tokenizer.json').resolve()}")
        provider = ModelProvider(str(folder / "model.safetensors"), tokenizer, calibration=config.Calibration.load(folder / "viterbi_calibration.json"))
    df = text_frame(spark, text)
    if args.mode == "redact":
        return R.redact(df, provider=provider).first()["redacted"]
    if args.mode == "mask":
        return json.dumps(R.mask(df, provider=provider).first()["masked"].asDict(True), ensure_ascii=False, indent=2)
    if args.mode == "tokens":
        if tokenizer is None:
            raise SystemExit("tokens needs --model")
        return json.dumps([t.asDict() for t in tokens(df, tokenizer).first()["tokens"]], ensure_ascii=False)
    return json.dumps([s.asDict() for s in D.detect(df, provider=provider, use_rules=not args.no_rules).first()["spans"]], ensure_ascii=False)


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate(), parser().parse_args()))
