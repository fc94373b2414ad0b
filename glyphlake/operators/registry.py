"""Named algorithms with typed arguments (R1-R8, P17, P18): registration, introspection, validation and dispatch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class ArgumentError(ValueError):
    """A required argument is missing or a value is out of range."""


class ArgumentTypeError(ArgumentError):
    """A value has another type than declared."""


@dataclass(frozen=True)
class Argument:
    """A named, typed argument. With a default it is optional; with bounds, values outside are refused."""

    name: str
    kind: type
    default: Any = None
    least: Any = None
    most: Any = None
    required: bool = True

    def bind(self, value: Any) -> Any:
        """The value to use for what a caller gave; None stands for nothing given."""
        if value is None:
            if self.default is None and self.required:
                raise ArgumentError(f"argument {self.name} is required")
            return self.default
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) if self.kind is float else isinstance(value, self.kind) and not (self.kind is int and isinstance(value, bool))
        if not ok:
            raise ArgumentTypeError(f"argument {self.name} must be {self.kind.__name__}, not {type(value).__name__}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ArgumentError(f"argument {self.name} must be from {self.least} to {self.most}, not {value}")
        return value


@dataclass(frozen=True)
class Algorithm:
    name: str
    run: Callable[..., Any]
    inputs: tuple[Argument, ...] = ()
    outputs: tuple[Argument, ...] = ()

    def __post_init__(self) -> None:
        for group in (self.inputs, self.outputs):
            names = [a.name for a in group]
            if len(set(names)) < len(names):
                raise ValueError(f"{self.name} declares an argument twice")


@dataclass
class Registry:
    algorithms: dict[str, Algorithm] = field(default_factory=dict)

    def register(self, algorithm: Algorithm) -> None:
        if algorithm.name in self.algorithms:
            raise ValueError(f"{algorithm.name} is registered already")
        self.algorithms[algorithm.name] = algorithm

    def get(self, name: str) -> Algorithm:
        if name not in self.algorithms:
            raise KeyError(f"no algorithm named {name}")
        return self.algorithms[name]

    def names(self) -> list[str]:
        return sorted(self.algorithms)

    def call(self, name: str, **given: Any) -> Any:
        """Bind what was given to the declared inputs and run; unknown names are refused."""
        algorithm = self.get(name)
        known = {a.name for a in algorithm.inputs}
        if extra := set(given) - known:
            raise ArgumentError(f"{name} has no argument {', '.join(sorted(extra))}")
        return algorithm.run(**{a.name: a.bind(given.get(a.name)) for a in algorithm.inputs})

    def describe(self, spark: SparkSession) -> DataFrame:
        """(algorithm, direction, argument, kind, default_value, least, most), a row per argument."""
        rows = [
            (x.name, way, a.name, a.kind.__name__, *[None if v is None else str(v) for v in (a.default, a.least, a.most)])
            for x in self.algorithms.values()
            for way, group in (("in", x.inputs), ("out", x.outputs))
            for a in group
        ]
        return spark.createDataFrame(rows, "algorithm string, direction string, argument string, kind string, default_value string, least string, most string")


def standard() -> Registry:
    """The algorithms that callers know by name, over tables instead of files."""
    from glyphlake.operators import collections, imageops

    def hough(pixels: DataFrame, rho: float, theta: float, threshold: int) -> DataFrame:
        return imageops.hough_lines(pixels, rho, theta, threshold)

    def add_image(users: DataFrame, images: DataFrame, emailid: str, imagepath: str):
        spark = users.sparkSession
        return collections.add_images(users, images, spark.createDataFrame([(emailid, imagepath)], "email string, path string"))

    def remove_image(images: DataFrame, emailid: str, imageid: int):
        return collections.remove_images(images, images.sparkSession.createDataFrame([(emailid, imageid)], "email string, image_id long"))

    one = lambda df, e: df.sparkSession.createDataFrame([(e,)], "email string")
    table = lambda name: Argument(name, DataFrame)
    email = Argument("emailid", str)
    out = Registry()
    for algorithm in (
        Algorithm("houghLines", hough, (table("pixels"), Argument("rho", float, 2.0, 1, 100), Argument("theta", float, 2.0, 1, 100), Argument("threshold", int, 2, 1, 255)), (table("lines"),)),
        Algorithm("integralImage", lambda pixels: imageops.integral_image(pixels), (table("pixels"),), (table("integral"),)),
        Algorithm("echo", lambda: "json output as requested", (), (Argument("output", str),)),
        Algorithm("adduser_emailid", lambda users, emailid: collections.add_users(users, one(users, emailid)), (table("users"), email), (table("users"), Argument("output", str))),
        Algorithm("deleteuser_emailid", lambda users, emailid: collections.delete_users(users, one(users, emailid)), (table("users"), email), (table("users"), Argument("output", str))),
        Algorithm("addimageuser_emailid", add_image, (table("users"), table("images"), email, Argument("imagepath", str)), (table("images"), Argument("imageid", int))),
        Algorithm("removeimageuser_emailid", remove_image, (table("images"), email, Argument("imageid", int, None, 0)), (table("images"), Argument("output", str))),
        Algorithm("retrieveimage_emailid", lambda ranked, images, topn: collections.retrieve(ranked, images, topn), (table("ranked"), table("images"), Argument("topn", int, None, 1, required=False)), (Argument("imageids", str),)),
    ):
        out.register(algorithm)
    return out
