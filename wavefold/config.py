"""Settings of a run, as YAML and back."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import yaml


#: The names and the default values below are fixed values: settings files hold them. Read are those of thresholds, of
#: clusters (but for the members and the xi, by which no point is left out), of hulls, tracks and columns; ``debug`` and
#: the labels of mesh arrays are only kept for such files.
@dataclass(frozen=True)
class Config:
    debug: bool
    scalar_name: str
    latitude_label: str
    longitude_label: str
    time_label: str
    clip_value: float
    extrema_threshold: float
    max_latitude: float | None
    min_latitude: float | None
    node_pruning_threshold: float
    edge_pruning_threshold: float
    max_edge_weight: float
    track_pruning_threshold: float = 8000.0
    track_weight_threshold: float | None = None
    cluster_max_eps_km: float = 3000.0
    cluster_min_samples: int = 2
    cluster_xi: float = 0.15
    min_longitude_separation: float = 6.0
    max_aspect_ratio: float = 1.5
    hull_method: str = "per_node"
    hemisphere: str = "north"
    penalty_length_scale_km: float = 2000.0
    energy_radius_km: float = 500.0
    lat_gate: float = 15.0
    vtk_value_label: str = "v"
    vtk_longitude_label: str = "Longitude"
    vtk_latitude_label: str = "Latitude"

    @classmethod
    def default(cls, **changes) -> Config:
        base = dict(debug=False, scalar_name="v", latitude_label="latitude", longitude_label="longitude", time_label="time", clip_value=2.0, extrema_threshold=10.0, max_latitude=None, min_latitude=None, node_pruning_threshold=20.0, edge_pruning_threshold=3e-5, max_edge_weight=1.0)
        return cls(**base | changes)

    def to_yaml(self, path: str | None = None) -> str:
        """The settings as YAML, written to ``path`` if there is one."""
        text = yaml.safe_dump(asdict(self), sort_keys=False)
        if path is not None:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    @classmethod
    def from_yaml(cls, source: str) -> Config:
        """From a file, or from YAML text (which has a line break or a colon and a space). Unknown keys raise TypeError."""
        text = str(source)
        if "\n" not in text and ": " not in text:
            with open(text, encoding="utf-8") as f:
                text = f.read()
        return cls.default(**(yaml.safe_load(text) or {}))
