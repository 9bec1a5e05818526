"""Models of other libraries, one series at a time inside the grouped map. Their packages are optional: register_external
registers those that are installed, and a model without its package says so when it is fitted."""

from __future__ import annotations

import importlib
import importlib.util
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..functions.contract import ID, TARGET, TIME
from ..functions.errors import EngineError
from ..functions.numeric import z_of
from ..functions.series_models import Model
from .forecaster import REGISTRY, register

BAND = 80


def _package(name: str):
    if importlib.util.find_spec(name) is None:
        raise EngineError(f"the package {name} is not installed")
    return importlib.import_module(name)


def _points(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """(means, sigma from the bounds of BAND where there are any) of a library's forecast frame of one series."""
    columns = [c for c in frame.columns if c not in (ID, TIME, "index", "cutoff")]
    means = [c for c in columns if "-lo-" not in c and "-hi-" not in c]
    if not means:
        raise EngineError(f"the forecast has no column of points; it has {list(frame.columns)}")
    lo, hi = (next((frame[c].to_numpy(float) for c in columns if c.endswith(f"-{s}-{BAND}")), None) for s in ("lo", "hi"))
    return frame[means[0]].to_numpy(float), None if lo is None or hi is None else (hi - lo) / (2 * z_of(BAND))


class External(Model):
    """A model whose forecasts come with the fit: state holds y, and means and sigmas are asked for with the horizon."""

    def ahead(self, y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError

    def run(self, y, h, x=None, xf=None):
        self.check(y)
        mean, sigma = self.ahead(np.asarray(y, float), h)
        if sigma is None:  # as a random walk's
            step = np.diff(y).std() if len(y) > 2 else 1.0
            sigma = max(float(step), 1e-12) * np.sqrt(np.arange(1, h + 1))
        return np.asarray(mean, float)[:h], np.asarray(sigma, float)[:h], {}


def _one(y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({ID: "series", TIME: np.arange(len(y)), TARGET: y})


@dataclass
class StatsForecastModel(External):
    """A named model of statsforecast."""

    model: str = "AutoARIMA"
    season_length: int = 1

    def ahead(self, y, h):
        _package("statsforecast")
        of = getattr(importlib.import_module("statsforecast.models"), self.model, None)
        if of is None:
            raise EngineError(f"statsforecast has no model {self.model!r}")
        try:
            made = of(season_length=self.season_length)
        except TypeError:  # one without seasons
            made = of()
        found = made.forecast(y=y, h=h, level=[BAND])
        return found["mean"], (np.asarray(found[f"hi-{BAND}"]) - np.asarray(found[f"lo-{BAND}"])) / (2 * z_of(BAND)) if f"lo-{BAND}" in found else None


@dataclass
class NeuralForecastModel(External):
    """A named model of neuralforecast, trained for the horizon."""

    model: str = "NHITS"
    max_steps: int = 100

    def ahead(self, y, h):
        of = getattr(importlib.import_module("neuralforecast.models") if _package("neuralforecast") else None, self.model, None)
        if of is None:
            raise EngineError(f"neuralforecast has no model {self.model!r}")
        net = _package("neuralforecast").NeuralForecast(models=[of(h=h, max_steps=self.max_steps)], freq=1)
        net.fit(df=_one(y))
        return _points(net.predict().reset_index())


@dataclass
class TimeGPTModel(External):
    """A hosted model; the key comes from the environment of the executors, so that it is in no plan."""

    model: str = "timegpt-1"
    client: object = None

    def ahead(self, y, h):
        client = self.client
        if client is None:
            key = os.environ.get("NIXTLA_API_KEY") or os.environ.get("TIMEGPT_API_KEY")
            if not key:
                raise EngineError("NIXTLA_API_KEY or TIMEGPT_API_KEY must be set")
            client = _package("nixtla").NixtlaClient(api_key=key)
        try:
            found = client.forecast(df=_one(y), h=h, freq=1, model=self.model, level=[BAND])
        except Exception as e:  # noqa: BLE001  whatever the service raises
            raise EngineError(f"the hosted forecast failed: {e}") from e
        return _points(found.reset_index())


#: Names, packages and classes.
KNOWN = {"statsforecast": ("statsforecast", StatsForecastModel), "neuralforecast": ("neuralforecast", NeuralForecastModel), "timegpt": ("nixtla", TimeGPTModel)}


def register_external() -> list[str]:
    """Registers the models whose package is installed and not yet registered; their names."""
    found = [(name, of) for name, (package, of) in KNOWN.items() if importlib.util.find_spec(package) is not None and name not in REGISTRY]
    for name, of in found:
        register(name, "statistical" if name == "statsforecast" else "ml")(of)
    return [name for name, _ in found]
