"""Settings of the tools, and a registry of conversions that a user adds."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column

from burin.operators import catalog, convert


class ConfigError(ValueError):
    """A setting that a tool does not take."""


def _check(ok: bool, name: str) -> None:
    if not ok:
        raise ConfigError(f"Configuración no válida: {name}")


@dataclass(frozen=True)
class Strip:
    mode: str = "light"
    blocks: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _check(self.mode in ("light", "deep"), "mode")
        _check(not isinstance(self.blocks, str) and all(isinstance(b, str) for b in self.blocks), "blocks")
        object.__setattr__(self, "blocks", tuple(self.blocks))


@dataclass(frozen=True)
class Vault:
    passphrase: str
    profile: str | None = None

    def __post_init__(self) -> None:
        _check(isinstance(self.passphrase, str) and len(self.passphrase) >= 1, "passphrase")
        _check(self.profile in (None, "standard", "high"), "profile")


@dataclass(frozen=True)
class Protect:
    status: str
    password: str

    def __post_init__(self) -> None:
        _check(self.status in ("add", "unlock"), "status")
        _check(isinstance(self.password, str) and len(self.password) >= 1, "password")


@dataclass(frozen=True)
class Sign:
    text: str
    pages: str = "todas"
    position: str = "abajo"

    def __post_init__(self) -> None:
        _check(isinstance(self.text, str) and len(self.text) >= 1, "text")
        _check(self.pages in ("todas", "primera"), "pages")
        _check(self.position in ("arriba", "centro", "abajo"), "position")


def _whole(value: Any, least: int, most: int | None = None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least and (most is None or value <= most)


@dataclass(frozen=True)
class Resize:
    width: int | None = None
    height: int | None = None
    percentage: float | None = None

    def __post_init__(self) -> None:
        _check(self.width is None or _whole(self.width, 1), "width")
        _check(self.height is None or _whole(self.height, 1), "height")
        _check(self.percentage is None or 1 <= self.percentage <= 400, "percentage")


@dataclass(frozen=True)
class Crop:
    width: int
    height: int
    x: int | None = None
    y: int | None = None

    def __post_init__(self) -> None:
        _check(_whole(self.width, 1), "width")
        _check(_whole(self.height, 1), "height")
        _check(self.x is None or _whole(self.x, 0), "x")
        _check(self.y is None or _whole(self.y, 0), "y")


@dataclass(frozen=True)
class Compress:
    quality: int | None = None

    def __post_init__(self) -> None:
        _check(self.quality is None or _whole(self.quality, 10, 100), "quality")


@dataclass(frozen=True)
class Split:
    pages: tuple[int, ...] | None = None
    output: str = "unido"
    mode: str = "rango"
    range: str = ""

    def __post_init__(self) -> None:
        _check(self.output in ("unido", "separado"), "output")
        _check(self.mode in ("rango", "pares", "impares", "cada"), "mode")


@dataclass(frozen=True)
class Convert:
    to: str
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _check(self.to in {c for c, _, _ in catalog.CONVERSIONS} | set(_added), "to")


TOOLS: dict[str, type] = {
    "meta.strip": Strip, "crypto.file": Vault, "pdf.protect": Protect, "pdf.sign": Sign, "image.resize": Resize, "image.crop": Crop,
    "image.compress": Compress, "pdf.split": Split, "convert.any": Convert,
}
_added: dict[str, tuple[tuple[str, ...], str]] = {}


def read(tool: str, values: Mapping[str, Any]) -> Any:
    """The settings of a tool from a mapping; unknown names are left out, a missing or wrong one raises ConfigError."""
    kind = TOOLS.get(tool)
    if kind is None:
        raise ConfigError(f"Herramienta desconocida: {tool}")
    known = {f.name for f in fields(kind)}
    try:
        return kind(**{k: v for k, v in values.items() if k in known})
    except TypeError as e:
        raise ConfigError(str(e)) from None


def conversion(name: str, kinds: tuple[str, ...], ext: str) -> Callable:
    """Decorator: adds a conversion, a function from Column to Column (null is an error), under a new id."""

    def add(make: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if name in convert.EXPRESSIONS or name in {c for c, _, _ in catalog.CONVERSIONS}:
            raise ConfigError(f"Conversión ya definida: {name}")
        convert.EXPRESSIONS[name] = make
        _added[name] = (tuple(kinds), ext)
        return make

    return add


def conversions_of(kind: str) -> list[str]:
    """Ids of all conversions of a kind, added ones last."""
    return [c for c, kinds, _ in catalog.CONVERSIONS if kind in kinds] + [c for c, (kinds, _) in _added.items() if kind in kinds]
