"""Configuration: the global file, sections' own files, and their resolution over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import SECTION_FILE


def _within(name: str, value: float, low: float, high: float, open_end: bool = False) -> None:
    if not (low <= value < high if open_end else low <= value <= high):
        raise ValueError(f"{name} is {value}; it must be in [{low}, {high}{')' if open_end else ']'}")


@dataclass(frozen=True)
class Model:
    max_context: int
    tokenizer_path: str
    embed_batch_size: int = 16

    def __post_init__(self) -> None:
        _within("max_context", self.max_context, 32, 1_000_000)
        _within("embed_batch_size", self.embed_batch_size, 1, 512)
        if not Path(self.tokenizer_path).exists():
            raise ValueError(f"no tokenizer at {self.tokenizer_path}")


@dataclass(frozen=True)
class Defaults:
    embed_model: str = "nomic-embed-text"
    chunk_size: int = 512
    chunk_overlap_ratio: float = 0.1
    headroom_ratio: float = 0.02
    retry_interval_seconds: int = 30
    retry_interval_max_seconds: int = 300

    def __post_init__(self) -> None:
        _within("chunk_size", self.chunk_size, 32, 32768)
        _within("chunk_overlap_ratio", self.chunk_overlap_ratio, 0, 1, open_end=True)
        _within("headroom_ratio", self.headroom_ratio, 0, 0.5)


@dataclass(frozen=True)
class Config:
    wiki_dir: str = "wiki"
    embedder_url: str = ""
    embed_timeout_seconds: int = 600
    size_cap_text_bytes: int = 10 << 20
    size_cap_other_bytes: int = 1 << 20
    deletion_grace_days: int = 7
    daemon_enabled: bool = True
    daemon_poll_seconds: int = 60
    models: dict[str, Model] = field(default_factory=dict)
    defaults: Defaults = field(default_factory=Defaults)

    def __post_init__(self) -> None:
        _within("embed_timeout_seconds", self.embed_timeout_seconds, 10, 3600)
        _within("deletion_grace_days", self.deletion_grace_days, 0, 365)
        if self.models:
            d = self.defaults
            if d.embed_model not in self.models:
                raise ValueError(f"the default model {d.embed_model} is not among the models")
            if d.chunk_size > usable_context(self.models[d.embed_model].max_context, d.headroom_ratio):
                raise ValueError(f"the default chunk size {d.chunk_size} does not fit {d.embed_model}")


def usable_context(max_context: int, headroom: float) -> int:
    return int(max_context * (1 - headroom))


def _made(kind: type, values: dict[str, Any] | None) -> Any:
    known = {f.name for f in fields(kind)}
    unknown = set(values or {}) - known
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**(values or {}))


def load_config(path: str | None = None) -> Config:
    """The file at ``path``, else at $CONFIG_PATH, else config.yaml; an empty file gives the defaults."""
    import yaml

    path = path or os.environ.get("CONFIG_PATH", "config.yaml")
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    raw["models"] = {k: _made(Model, v) for k, v in (raw.get("models") or {}).items()}
    raw["defaults"] = _made(Defaults, raw.get("defaults"))
    return _made(Config, raw)


@dataclass(frozen=True)
class SectionSettings:
    """What a section's file says; None inherits."""

    description: str = ""
    embed_model: str | None = None
    chunk_size: int | None = None
    chunk_overlap_ratio: float | None = None
    headroom_ratio: float | None = None

    def __post_init__(self) -> None:
        if self.chunk_size is not None:
            _within("chunk_size", self.chunk_size, 32, 32768)
        if self.chunk_overlap_ratio is not None:
            _within("chunk_overlap_ratio", self.chunk_overlap_ratio, 0, 1, open_end=True)
        if self.headroom_ratio is not None:
            _within("headroom_ratio", self.headroom_ratio, 0, 0.5)


def load_section(directory: str | Path) -> SectionSettings | None:
    """None for a directory that is no section."""
    import yaml

    path = Path(directory) / SECTION_FILE
    if not path.is_file():
        return None
    return _made(SectionSettings, yaml.safe_load(path.read_text(encoding="utf-8")))


def resolve(raw: DataFrame, models: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Raw settings (section, embed_model, chunk_size, chunk_overlap_ratio, headroom_ratio, others) over ``defaults``.

    Adds chunk_overlap (cut to a whole number), embed_batch_size and disabled_reason. Models (model, max_context, embed_batch_size) is a registry
    of a few rows; where it is empty every section is enabled. An unknown model or a chunk size that doesn't fit disables a section, and keeps it.
    """
    any_model = bool(models.limit(1).take(1))
    given = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k != "embed_model"}
    s = raw.withColumns({**given, "embed_model": F.coalesce(F.nullif("embed_model", F.lit("")), F.lit(defaults["embed_model"]))})
    s = s.withColumn("chunk_overlap", (F.col("chunk_size") * F.col("chunk_overlap_ratio")).cast("int"))
    s = s.join(F.broadcast(models), F.col("embed_model") == F.col("model"), "left_outer")
    usable = (F.col("max_context") * (1 - F.col("headroom_ratio"))).cast("int")
    unknown = F.concat(F.lit("unknown model "), F.col("embed_model"))
    large = F.concat(F.lit("chunk_size "), F.col("chunk_size").cast("string"), F.lit(" exceeds "), usable.cast("string"))
    reason = F.when(F.col("model").isNull(), unknown).when(F.col("chunk_size") > usable, large)
    s = s.withColumn("disabled_reason", reason if any_model else F.lit(None).cast("string"))
    return s.withColumn("embed_batch_size", F.coalesce("embed_batch_size", F.lit(16))).drop("model", "max_context")


RAW = "section string, path string, description string, embed_model string, chunk_size int, chunk_overlap_ratio double, headroom_ratio double"
MODELS = "model string, max_context int, embed_batch_size int"


def discover_sections(spark: SparkSession, config: Config) -> DataFrame:
    """Resolved sections by name, disabled ones too: the directories of wiki_dir with a section file, read anew at each call."""
    root = Path(config.wiki_dir)
    rows = []
    for d in sorted(root.iterdir()) if root.is_dir() else []:
        if d.is_dir() and (s := load_section(d)) is not None:
            rows.append((d.name, str(d), s.description, s.embed_model, s.chunk_size, s.chunk_overlap_ratio, s.headroom_ratio))
    models = spark.createDataFrame([(k, m.max_context, m.embed_batch_size) for k, m in config.models.items()], MODELS)
    d = config.defaults
    defaults = {"embed_model": d.embed_model, "chunk_size": d.chunk_size, "chunk_overlap_ratio": d.chunk_overlap_ratio, "headroom_ratio": d.headroom_ratio}
    return resolve(spark.createDataFrame(rows, RAW), models, defaults).withColumn("enabled", F.col("disabled_reason").isNull()).orderBy("section")
