"""Pipelines: stages that declare which interval of their inputs an output needs, planned backwards from the output.

Buffers are lazy.  ``Pipeline.evaluate`` starts from the requested output boxes, takes the hull of what all consumers
need of each buffer, checks that the inputs cover it, cuts the inputs there, builds each stage once and checks that what it
gives covers what is needed.  Tiling, placement, caching and partition counts are hints: results do not depend on them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from inspect import signature

from pyspark import StorageLevel

from ..functions.interval import Box, Interval
from ..operators import reindex
from ..sources.frame import ArrayFrame

Need = Callable[..., Box]  # of the output's box and, if it takes a second argument, of the scalars by name


class InsufficientInput(ValueError):
    """An input's box does not cover what the output needs."""


class InsufficientStage(ValueError):
    """A stage's result does not cover what its consumers need: its inputs' footprint is declared too small."""


@dataclass(eq=False)
class Buffer:
    name: str
    dims: tuple[str, ...]
    producer: Stage | None = None
    constant: ArrayFrame | None = None
    root: bool = False
    partitions: int | None = None
    level: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)

    def compute_root(self) -> Buffer:
        """Keep the stage's result for all its consumers, until the pipeline is released."""
        self.root = True
        return self

    def compute_inline(self) -> Buffer:
        """Part of each consumer's own plan, the default."""
        self.root = False
        return self

    def store_in(self, level: StorageLevel) -> Buffer:
        """Where a kept result lies."""
        self.level = level
        return self

    def repartition(self, n: int) -> Buffer:
        self.partitions = n
        return self


@dataclass(eq=False)
class Stage:
    """kernel gets the inputs, cut to what is needed, then the scalars: the pipeline's arguments, then its lets in order.  It
    gives an array, or one for each output.  data is the caller's own and is not looked at."""

    kernel: Callable[..., ArrayFrame | tuple[ArrayFrame, ...]]
    inputs: list[tuple[Buffer, Need]]
    outputs: list[Buffer]
    name: str = ""
    align: dict[str, int] = field(default_factory=dict)
    data: object = None

    @property
    def title(self) -> str:
        return self.name or getattr(self.kernel, "__name__", "stage")

    def __post_init__(self):
        for b in self.outputs:
            if b.producer:
                raise ValueError(f"{b.name} has a producer already")
            b.producer = self


def pointwise(out: Box) -> Box:
    return out


def halo(**taps: tuple[int, int]) -> Need:
    from ..operators.stencil import required

    return lambda out: required(out, taps)


@dataclass
class Pipeline:
    """args: names of scalars; lets: scalars derived from these and earlier lets, in order.

    trace is told (event, stage, seconds) where a stage begins and ends to be built.  on_failure gets what a stage raises
    and its outputs' needs, and may give arrays in its place; without one the exception passes.
    """

    inputs: list[Buffer]
    outputs: list[Buffer]
    args: tuple[str, ...] = ()
    lets: dict[str, Callable[..., int]] = field(default_factory=dict)
    checks: bool = True
    trace: Callable[[str, str, float], None] | None = None
    on_failure: Callable[[Exception, dict[str, Box]], dict[str, ArrayFrame]] | None = None
    kept: list[ArrayFrame] = field(default_factory=list)

    def order(self) -> list[Stage]:
        """Producers before consumers."""
        seen: list[Stage] = []

        def visit(b: Buffer, path: tuple[Stage, ...] = ()) -> None:
            s = b.producer
            if s is None or s in seen:
                return
            if s in path:
                raise ValueError(f"{b.name} depends on itself")
            for i, _ in s.inputs:
                visit(i, (*path, s))
            seen.append(s)

        for b in self.outputs:
            visit(b)
        return seen

    def needs(self, boxes: dict[str, Box], scalars: dict[str, int] | None = None) -> dict[Buffer, Box]:
        """The box of every buffer that the output boxes need."""
        out = {b: boxes[b.name] for b in self.outputs}
        for s in reversed(self.order()):
            own = [out[b] for b in s.outputs if b in out]
            if not own:
                continue
            whole = own[0]
            if len(own) > 1:
                whole = max(own, key=len)
                for o in own:
                    whole = Box({d: i | o[d] if d in o else i for d, i in whole.items()})
            whole = Box({d: i.align(s.align[d]) if d in s.align else i for d, i in whole.items()})
            for b, need in s.inputs:
                asked = need(whole, scalars or {}) if len(signature(need).parameters) == 2 else need(whole)
                out[b] = out[b] | asked if b in out else asked
        return out

    def evaluate(self, boxes: dict[str, Box], arrays: dict[str, ArrayFrame], scalars: dict[str, int] | None = None) -> dict[str, ArrayFrame]:
        values = dict(scalars or {})
        if missing := set(self.args) - set(values):
            raise ValueError(f"no value for {sorted(missing)}")
        for name, f in self.lets.items():
            values[name] = f(values)
        passed = [values[n] for n in dict.fromkeys([*self.args, *self.lets])]
        needs = self.needs(boxes, values)
        have: dict[Buffer, ArrayFrame] = {}
        for b, box in needs.items():
            if b.producer is None:
                src = b.constant or arrays[b.name]
                if self.checks and not src.box.contains(box):
                    raise InsufficientInput(f"{b.name} has {dict(src.box)}, {dict(box)} is needed")
                have[b] = reindex.crop(src, box)
        for s in self.order():
            used = [b for b in s.outputs if b in needs]
            if used:
                have |= self._build(s, used, needs, have, passed)
        return {b.name: have[b] for b in self.outputs}

    def _build(self, s: Stage, used: list[Buffer], needs: dict[Buffer, Box], have: dict[Buffer, ArrayFrame], scalars: list) -> dict[Buffer, ArrayFrame]:
        began = time.perf_counter()
        if self.trace:
            self.trace("begin", s.title, 0.0)
        try:
            got = s.kernel(*[reindex.crop(have[b], needs[b]) for b, _ in s.inputs], *scalars)
            made = dict(zip(s.outputs, got if isinstance(got, tuple) else (got,)))
            for b in used:
                if self.checks and not made[b].box.contains(needs[b]):
                    raise InsufficientStage(f"{s.title} gives {dict(made[b].box)} of {b.name}, {dict(needs[b])} is needed")
        except Exception as e:
            if not self.on_failure:
                raise
            instead = self.on_failure(e, {b.name: needs[b] for b in used})
            made = {b: instead[b.name] for b in used}
        out = {}
        for b in used:
            a = reindex.crop(made[b], needs[b])
            if b.partitions:
                a = ArrayFrame(a.df.repartition(b.partitions), a.box, a.sparse)
            if b.root:
                a = ArrayFrame(a.df.persist(b.level), a.box, a.sparse)
                self.kept.append(a)
            out[b] = a
        if self.trace:
            self.trace("end", s.title, time.perf_counter() - began)
        return out

    def release(self) -> None:
        """Free what roots have kept; results already taken stay valid, as they can be computed again."""
        for a in self.kept:
            a.df.unpersist()
        self.kept.clear()

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def tiles(self, boxes: dict[str, Box], steps: dict[str, int]) -> Iterator[dict[str, Box]]:
        """The output boxes cut by steps along dimensions, the innermost named first; the last tile of a row is clamped."""
        todo = [boxes]
        for d, n in reversed(steps.items()):
            todo = [{k: v.with_(**{d: v[d] & Interval(lo, lo + n - 1)}) if d in v else v for k, v in t.items()} for t in todo for lo in range(next(v[d].min for v in t.values() if d in v), 1 + max(v[d].max for v in t.values() if d in v), n)]
        yield from todo

    def loop(self, boxes: dict[str, Box], steps: dict[str, int], arrays: dict[str, ArrayFrame], scalars: dict[str, int] | None = None) -> dict[str, ArrayFrame]:
        """As evaluate, tile by tile; the tiles are one union, which Spark runs side by side."""
        parts = [self.evaluate(t, arrays, scalars) for t in self.tiles(boxes, steps)]
        out = {}
        for name, box in boxes.items():
            df = parts[0][name].df
            for p in parts[1:]:
                df = df.unionByName(p[name].df)
            out[name] = ArrayFrame(df, box, parts[0][name].sparse)
        return out

    def start(self, act: Callable[[dict[str, ArrayFrame]], object], *args, **kwargs) -> Future:
        """Evaluate and act on the results in a thread; the future's result() waits for it."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(lambda: act(self.evaluate(*args, **kwargs)))
        finally:
            pool.shutdown(wait=False)

    def depends(self, b: Buffer) -> set[Buffer]:
        """All buffers that a buffer is made from."""
        out: set[Buffer] = set()
        todo = [b]
        while todo:
            s = todo.pop().producer
            for i, _ in s.inputs if s else ():
                if i not in out:
                    out.add(i)
                    todo.append(i)
        return out

    def substitute(self, names: dict[str, Buffer]) -> Pipeline:
        """The same graph with new buffers, where buffers of these names are others; what made those is left out."""
        new: dict[Buffer, Buffer] = {}

        def of(b: Buffer) -> Buffer:
            return names[b.name] if b.name in names else new.setdefault(b, replace(b, producer=None))

        todo = list(self.outputs)
        stages: list[Stage] = []
        while todo:
            b = todo.pop()
            if b.name not in names and b.producer and b.producer not in stages:
                stages.append(b.producer)
                todo += [i for i, _ in b.producer.inputs]
        for s in stages:
            replace(s, inputs=[(of(i), need) for i, need in s.inputs], outputs=[of(o) if o.name not in names else replace(o, producer=None) for o in s.outputs])
        ends = [of(b) for b in self.outputs]
        inputs = [names.get(b.name) or of(b) for b in self.inputs]
        return replace(self, inputs=inputs, outputs=ends, kept=[])

    def shape(self) -> tuple:
        """What two pipelines of the same structure share: stages by title, with the names of what they read and give."""
        return tuple((s.title, tuple(b.name for b, _ in s.inputs), tuple(b.name for b in s.outputs)) for s in self.order())

    def source(self) -> str:
        """Python that builds this graph again, given the kernels and needs by name."""
        buffers = {b.name: b for s in self.order() for b in [*[i for i, _ in s.inputs], *s.outputs]} | {b.name: b for b in [*self.inputs, *self.outputs]}
        lines = [f"{n} = Buffer({n!r}, {b.dims!r})" for n, b in buffers.items()]
        for s in self.order():
            lines.append(f"Stage(kernels[{s.title!r}], [{', '.join(f'({b.name}, needs[{s.title!r}][{i}])' for i, (b, _) in enumerate(s.inputs))}], [{', '.join(b.name for b in s.outputs)}], {s.title!r}, {s.align!r})")
        lines.append(f"pipeline = Pipeline([{', '.join(b.name for b in self.inputs)}], [{', '.join(b.name for b in self.outputs)}], {self.args!r}, lets)")
        return "\n".join(lines)

    def dot(self) -> str:
        """The graph, for Graphviz."""
        lines = ["digraph pipeline {"]
        for s in self.order():
            for b in s.outputs:
                lines += [f'  "{i.name}" -> "{b.name}" [label="{s.title}"];' for i, _ in s.inputs] or [f'  "{b.name}";']
        return "\n".join([*lines, "}"])

    def describe(self, boxes: dict[str, Box]) -> str:
        """What is needed of each buffer."""
        return "\n".join(f"{b.name}: " + ", ".join(f"{d} in [{i.min}, {i.max}]" for d, i in box.items()) for b, box in self.needs(boxes).items())


def tile_sizes(width: int, area: int) -> tuple[int, int]:
    """Width and height of a tile of about an area."""
    x = min(width, area)
    return x, max(1, area // x)
