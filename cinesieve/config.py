"""Settings of a curation run: defaults, a JSON file, and overrides that are checked before they count."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Extraction:
    fps: float = 5
    mode: str = "fps"
    scene_threshold: float = 27.0
    jpeg_quality: int = 2


@dataclass(frozen=True)
class Filter:
    blur_threshold: float = 80.0
    similarity_threshold: float = 0.70
    dedup_method: str = "phash"
    phash_size: int = 16


@dataclass(frozen=True)
class Scorer:
    enabled: bool = False
    top_n: int = 30
    save_score_report: bool = True


@dataclass(frozen=True)
class Output:
    keep_raw: bool = False
    generate_html_preview: bool = True
    preview_columns: int = 5
    report_json: bool = True


@dataclass(frozen=True)
class Config:
    extraction: Extraction = field(default_factory=Extraction)
    filter: Filter = field(default_factory=Filter)
    scorer: Scorer = field(default_factory=Scorer)
    output: Output = field(default_factory=Output)
    warnings: tuple[str, ...] = ()
    #: Whether the settings of the extraction were stated, so that a run that can't heed them says so.
    extraction_given: bool = False


def from_dict(given: dict) -> Config:
    """Known keys of the four sections; missing ones have their defaults, keys with a leading underscore are comments."""
    config = Config()
    if not isinstance(given, dict):
        return replace(config, warnings=("the configuration is not an object; defaults are used",))
    notes = []
    for part in fields(config):
        section = given.get(part.name)
        default = getattr(config, part.name)
        if section is None or not is_dataclass(default):
            continue
        if not isinstance(section, dict):
            notes.append(f"section {part.name} is not an object; its defaults are used")
            continue
        known = {f.name for f in fields(default)}
        config = replace(config, **{part.name: replace(default, **{k: v for k, v in section.items() if k in known and v is not None})})
    return replace(config, warnings=tuple(notes), extraction_given=bool(given.get("extraction")))


def load(spark: SparkSession, path: str) -> Config:
    """The file at any path that Spark reads; a missing or malformed one gives the defaults and a warning."""
    try:
        return from_dict(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())))
    except Exception as error:  # noqa: BLE001  whatever is wrong with it, a run goes on with the defaults
        return Config(warnings=(f"{path} can't be used ({type(error).__name__}); defaults are used",))


def overridden(config: Config, mode: str | None = None, fps: float | None = None, blur: float | None = None, sim: float | None = None, method: str | None = None, top: int | None = None, keep_raw: bool = False, no_html: bool = False, no_report: bool = False) -> Config:
    """config with what was given; a value out of range leaves the setting as it is and adds a warning."""
    notes = list(config.warnings)
    changes: dict[str, dict] = {"extraction": {}, "filter": {}, "scorer": {}, "output": {}}

    def put(section: str, name: str, value, fine: bool, must: str) -> None:
        if value is None:
            return
        if fine:
            changes[section][name] = value
        else:
            notes.append(f"{name} must be {must}, not {value}; {getattr(getattr(config, section), name)} stays")

    put("extraction", "mode", mode, True, "")
    put("extraction", "fps", fps, fps is not None and fps > 0, "over 0")
    put("filter", "blur_threshold", blur, blur is not None and blur >= 0, "0 or more")
    put("filter", "similarity_threshold", sim, sim is not None and 0 < sim < 1, "between 0 and 1")
    put("filter", "dedup_method", method, True, "")
    put("scorer", "top_n", top, top is not None and top > 0, "over 0")
    if "top_n" in changes["scorer"]:
        changes["scorer"]["enabled"] = True
    changes["output"] |= {k: v for k, v in {"keep_raw": keep_raw or None, "generate_html_preview": False if no_html else None, "report_json": False if no_report else None}.items() if v is not None}
    stated = config.extraction_given or bool(changes["extraction"])
    return replace(config, warnings=tuple(notes), extraction_given=stated, **{s: replace(getattr(config, s), **c) for s, c in changes.items()})
