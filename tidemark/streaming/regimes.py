"""The learned regimes of each camera as a stream's state: a map from a regime to its grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.regimes import Camera, Regime, RegimeConfig

OUT = "device long, id long, regime int, distance double, shift double, blobs int, largest int, channel string, decision string"


class _Cameras(StatefulProcessor):
    def __init__(self, height: int, width: int, config: RegimeConfig):
        self.shape, self.config = (height, width), config

    def init(self, handle: StatefulProcessorHandle) -> None:
        # grids as bytes of doubles: eleven layers, of means, variances and texture
        self.regimes = handle.getMapState("regimes", "regime int", "grids binary, descriptor array<double>, count long")
        self.rest = handle.getValueState("rest", "named int, moved int, reference binary")

    def _loaded(self) -> Camera:
        camera = Camera(self.config)
        if self.rest.exists():
            camera.named, camera.moved, reference = self.rest.get()
            camera.reference = np.frombuffer(reference).reshape(self.shape) if reference is not None else None
        if self.regimes.exists():
            for (k,), (grids, descriptor, count) in self.regimes.iterator():
                layers = np.frombuffer(grids).reshape(11, *self.shape)
                camera.regimes[k] = Regime(layers[:5], layers[5:10], layers[10], np.array(descriptor), count)
        return camera

    def _keep(self, camera: Camera, before: dict[int, Regime]) -> None:
        for k in before.keys() - camera.regimes.keys():
            self.regimes.removeKey((k,))
        for k, r in camera.regimes.items():
            if before.get(k) is not r:  # those that learned nothing stay as they are
                self.regimes.updateValue((k,), (np.concatenate((r.levels, r.spreads, r.detail[None])).tobytes(), r.descriptor.tolist(), int(r.count)))
        self.rest.update((int(camera.named), int(camera.moved), None if camera.reference is None else np.ascontiguousarray(camera.reference).tobytes()))

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        camera = self._loaded()
        before, out = dict(camera.regimes), []
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        for event, teaches, *planes in zip(rows["id"], rows["teaches"], rows["r"], rows["g"], rows["b"], strict=True):
            frame = np.array([np.asarray(p, float) for p in planes]).reshape(3, *self.shape)
            out.append((key[0], event, *camera.see(frame, bool(teaches))))
        self._keep(camera, before)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def regimes(stream: DataFrame, height: int, width: int, config: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Each frame of a stream of (device, us, id, teaches, r, g, b), the last three its planes, with its regime, the distance
    to it, the camera's shift, blobs and decision. Rows of a device within a batch are put in order, a batch behind another
    is later. A device's state is bounded: some regimes of eleven grids each, of which those that learned are written."""
    rows = stream.select("device", "us", "id", "teaches", "r", "g", "b")
    return rows.groupBy("device").transformWithStateInPandas(_Cameras(height, width, config), OUT, "append", "none")
