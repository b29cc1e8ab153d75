"""What the text operators share: the worker path, small expressions, tokenizer files; ``materialize`` writes a table to the
shared folder and rereads it, so a lost executor costs only the tasks of the later stages."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written as materialize

__all__ = ["ascii_lower", "let", "load_tokenizer", "materialize", "prepare", "tokenizer_path"]

#: The ASCII white space that ends a word, as members of a character class.
SPACE_CLASS = r"\x20\x09-\x0D"
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package even where it isn't installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (root, env.get("PYTHONPATH", "")) if p)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would change other scripts too)."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row; a plain alias could be inlined into every lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, found on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}


def load_tokenizer(name_or_path: str):
    """The tokenizer, once per worker process. A bare file name is looked up among the public tokenizers there."""
    if name_or_path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name_or_path if os.path.sep in name_or_path else tokenizer_path(name_or_path)
        _LOADED[name_or_path] = Tokenizer.from_file(path)
    return _LOADED[name_or_path]
