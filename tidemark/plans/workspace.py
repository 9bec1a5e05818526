"""A console's state as one JSON file, the panel of its sources, and the watched part of it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import ID, TARGET, TIME, validate_panel
from ..functions.errors import DataContractError, EngineError
from ..sources.readers import CSVSource
from ..sources.synthetic import demo_panel

FILE, HOME = "workspace.json", "TIDEMARK_HOME"
#: Settings with their defaults, and those that may be null.
SETTINGS = {"model": "auto_ets", "h": 6, "level": 80, "refresh_seconds": 0, "season_length": None}
NULLABLE = ("refresh_seconds", "season_length")


def _whole(value) -> bool:
    if isinstance(value, bool):
        return False
    try:
        int(value)
    except (TypeError, ValueError, OverflowError):
        return False
    return True


@dataclass
class Workspace:
    """sources: dicts with a CSV path and, where wanted, a mapping and its overrides. watch: series to show (none: all). settings: of
    the models run. alerts: dicts with kind, series and threshold. Unknown settings are kept as they are."""

    sources: list = field(default_factory=list)
    watch: list = field(default_factory=list)
    settings: dict = field(default_factory=lambda: dict(SETTINGS))
    alerts: list = field(default_factory=list)
    home: str | None = None

    @staticmethod
    def home_of(home=None) -> Path:
        return Path(home or os.environ.get(HOME) or Path.home() / ".tidemark").expanduser()

    @classmethod
    def load(cls, home=None) -> Workspace:
        """The workspace under home; a new one where there is no file. What a file leaves out has its default; what it
        holds in a wrong kind is an error that names it."""
        at = cls.home_of(home)
        path = at / FILE
        if not path.exists():
            return cls(home=str(at))
        try:
            raw = json.loads(path.read_text())
        except (OSError, ValueError) as e:
            raise EngineError(f"{path} cannot be read: {e}") from e
        problems = [] if isinstance(raw, dict) else ["it is no object"]
        held = raw if isinstance(raw, dict) else {}
        for name, kind in (("sources", list), ("watch", list), ("settings", dict), ("alerts", list)):
            if held.get(name) is not None and not isinstance(held[name], kind):
                problems.append(f"{name} is no {kind.__name__}")
        if not problems:
            problems += [f"{n}[{i}] is no object" for n in ("sources", "alerts") for i, x in enumerate(held.get(n) or []) if not isinstance(x, dict)]
        if not problems:
            problems += [f"sources[{i}].overrides is no object" for i, x in enumerate(held.get("sources") or []) if x.get("overrides") and not isinstance(x["overrides"], dict)]
            settings = SETTINGS | (held.get("settings") or {})
            for name, default in SETTINGS.items():
                value = settings[name]
                fine = value is None and name in NULLABLE or (isinstance(value, str) if isinstance(default, str) else value is not None and _whole(value))
                problems += [] if fine else [f"settings.{name} is {value!r}"]
        if problems:
            raise EngineError(f"{path}: {'; '.join(problems)}")
        sources = [{"path": None, "mapping": None} | x | {"overrides": dict(x.get("overrides") or {})} for x in held.get("sources") or []]
        return cls(sources, [str(x) for x in held.get("watch") or []], settings, [dict(x) for x in held.get("alerts") or []], str(at))

    def save(self) -> Path:
        """Writes the file in one step: a reader sees the old one or the new one."""
        if self.home is None:
            raise EngineError("the workspace has no home")
        at = Path(self.home).expanduser()
        at.mkdir(parents=True, exist_ok=True)
        draft = at / f".{FILE}.draft"
        draft.write_text(json.dumps({k: v for k, v in asdict(self).items() if k != "home"}, indent=2, sort_keys=True))
        os.replace(draft, at / FILE)
        return at / FILE

    # -- what it describes

    def panel(self, spark: SparkSession) -> DataFrame:
        """The validated panel of all sources together; the demo panel where there are none."""
        if not self.sources:
            return demo_panel(spark)
        parts = []
        for source in self.sources:
            try:
                of = CSVSource(spark, source.get("path"), mapping=source.get("mapping"))
                part = of.to_panel(**(source.get("overrides") or {})) if source.get("mapping") else of.fetch()
                if missing := [c for c in (ID, TIME, TARGET) if c not in part.columns]:
                    raise DataContractError(f"column(s) {missing} are missing, and there is no mapping")
                parts.append(validate_panel(part.select(F.col(ID).cast("string").alias(ID), TIME, TARGET)))
            except Exception as e:  # noqa: BLE001  whatever reading raises
                raise EngineError(f"source {source.get('path')!r} failed to load: {str(e)[:300]}") from e
        try:
            return validate_panel(reduce(DataFrame.unionByName, parts))
        except EngineError as e:
            raise EngineError(f"the sources' panels do not go together: {e}") from e

    def watched(self, frame: DataFrame) -> DataFrame:
        """The rows of the watched series; all where none is watched."""
        return frame.filter(F.col(ID).isin(*self.watch)) if self.watch else frame

    def rules(self, spark: SparkSession) -> DataFrame:
        """The alert rules as a table for engine.alerts."""
        rows = [(str(a.get("series", "*")), str(a["kind"]), float(a["threshold"])) for a in self.alerts]
        return spark.createDataFrame(rows, "series string, kind string, threshold double")
