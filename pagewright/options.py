"""Immutable options. Overrides merge at any depth; unknown names are rejected."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class ModelOptions:
    """Paths of ONNX files, or callables from a tensor to an array; the dictionary is a path or a tuple."""

    detection: object = None
    recognition: object = None
    dictionary: object = None


@dataclass(frozen=True)
class DetectionOptions:
    # fixed values
    mean: tuple = (0.485, 0.456, 0.406)
    std: tuple = (0.229, 0.224, 0.225)
    max_side: int = 960
    min_area: float = 20
    pad_vertical: float = 0.4
    pad_horizontal: float = 0.6
    #: As the original does: a 0 for area or padding means the default.
    zero_is_default: bool = True

    def __post_init__(self):
        if len(self.mean) != 3 or len(self.std) != 3:
            raise ValueError("mean and std need three values")
        if self.zero_is_default:
            for f in fields(self):
                if f.name in ("min_area", "pad_vertical", "pad_horizontal") and not getattr(self, f.name):
                    object.__setattr__(self, f.name, f.default)


@dataclass(frozen=True)
class RecognitionOptions:
    image_height: int = 48
    dictionary: tuple = ()


@dataclass(frozen=True)
class DebugOptions:
    verbose: bool = False
    debug: bool = False
    folder: str = "out"


@dataclass(frozen=True)
class OcrOptions:
    model: ModelOptions = field(default_factory=ModelOptions)
    detection: DetectionOptions = field(default_factory=DetectionOptions)
    recognition: RecognitionOptions = field(default_factory=RecognitionOptions)
    debugging: DebugOptions = field(default_factory=DebugOptions)


def merged(options, changes: dict | None):
    """options with changes, which name fields and may hold dicts for nested options."""
    if not changes:
        return options
    known = {f.name for f in fields(options)}
    if bad := sorted(set(changes) - known):
        raise ValueError(f"unknown options: {', '.join(bad)}")
    new = {}
    for name, value in changes.items():
        own = getattr(options, name)
        new[name] = merged(own, value) if is_dataclass(own) and isinstance(value, dict) else tuple(value) if isinstance(value, list) else value
    return replace(options, **new)
