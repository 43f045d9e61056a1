"""Options of the model pipeline, from code or from the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from volumetra.operators import network, training


@dataclass
class Options:
    """Defaults of training and evaluation; each is a command line option of the same name.

    ``model``: ``readout`` (ridge regression) or ``network``. ``way``: ``holdout`` with ``share`` of each dataset's participants for training, or ``leave_one_out``, a round for each dataset.
    Rotation in degrees, shift in voxels and zoom in per cent bound the augmentation of training volumes. A training step takes a part of all samples: they are dealt to ``steps`` batches.
    """

    model: str = "readout"
    way: str = "holdout"
    epochs: int = 25
    steps: int = 1500
    subsamples: int = 10
    share: float = 0.6
    percent: float = 80.0
    ridge: float = 1.0
    rate: float = 0.00002
    confidence: float = 0.1
    filters: int = 32
    depth: int = 4
    dense: int = 2
    units: int = 1024
    dropout: float = 0.1
    rotation: int = 5
    shift: int = 4
    zoom: int = 15
    groups: int = 8
    seed: int = 0

    @classmethod
    def from_args(cls, args: list[str] | None = None) -> Options:
        parser = argparse.ArgumentParser(description=cls.__doc__)
        for f in fields(cls):
            parser.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
        return cls(**vars(parser.parse_args(args)))

    def layers(self) -> list[network.Layer]:
        return network.gaze_layers(self.filters, 3, self.depth, 2, self.groups, self.subsamples, self.dense, self.units, self.dropout)

    def recipe(self) -> training.Recipe:
        return training.Recipe(self.rate, self.epochs, self.steps, self.confidence, 0.9, self.seed, self.rotation, self.shift, self.zoom)
