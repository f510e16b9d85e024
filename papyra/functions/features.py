"""Optional features, their levels and what they need, and the presets that switch them on: configuration on the driver."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable
from pathlib import Path

# Fixed values: (level, needed packages) of each feature, and the features of each preset.
FEATURES = {
    "trocr": ("advanced", ["torch", "transformers", "torchvision"]), "table_transformer": ("advanced", ["torch", "transformers", "detectron2"]), "llava_next": ("experimental", ["torch", "transformers", "accelerate"]),
    "quality_assessment": ("basic", ["scikit-learn", "scipy"]), "async_processing": ("basic", ["aiofiles", "asyncio"]), "multilingual": ("advanced", ["spacy", "langdetect", "polyglot"]),
    "gpu_acceleration": ("advanced", ["cupy-cuda11x"]), "advanced_caching": ("basic", ["redis", "joblib"]),
}
PRESETS = {
    "basic": ["quality_assessment", "async_processing"], "advanced": ["trocr", "table_transformer", "quality_assessment", "async_processing", "multilingual"],
    "experimental": ["trocr", "table_transformer", "llava_next", "quality_assessment", "async_processing", "multilingual"], "performance": ["gpu_acceleration", "advanced_caching", "async_processing"],
    "quality": ["trocr", "table_transformer", "quality_assessment", "multilingual"],
}


def installed(package: str) -> bool:
    try:
        return importlib.util.find_spec(package.replace("-", "_")) is not None
    except (ImportError, ValueError):
        return False


class Features:
    """The switches of one session; ``has`` tells whether a package is there."""

    def __init__(self, has: Callable[[str], bool] = installed):
        self.has, self.on = has, set()

    def missing(self, name: str) -> list[str]:
        return [p for p in FEATURES[name][1] if not self.has(p)]

    def enable(self, name: str, check: bool = True) -> bool:
        """Whether the feature is on now: not for an unknown name, nor, if checked, where a package is missing."""
        if name not in FEATURES or check and self.missing(name):
            return False
        self.on.add(name)
        return True

    def disable(self, name: str) -> bool:
        self.on.discard(name)
        return name in FEATURES

    def preset(self, name: str) -> bool:
        """Switch on what can be of a preset; whether any could."""
        return any([self.enable(f) for f in PRESETS.get(name, [])])

    def available(self) -> list[str]:
        return [f for f in FEATURES if not self.missing(f)]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"enabled_features": [f for f in FEATURES if f in self.on], "feature_configs": {f: {"enabled": f in self.on, "level": FEATURES[f][0]} for f in FEATURES}}, indent=2))

    def load(self, path: str) -> None:
        for name in json.loads(Path(path).read_text()).get("enabled_features", []):
            self.enable(name, check=False)
