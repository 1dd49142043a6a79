"""Graphs of named nodes and streams: built by calls or read from JSON, checked, run lazily.

A node's function takes its input DataFrames (and its options) and gives one or
several; nothing runs until an output is used, and Catalyst plans all of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.plans.modules import Module, registry
from rivulet.stream import Stream

MODES = ("normal", "server", "generator", "subgraph", "pushdata")


class GraphError(ValueError):
    """A graph that cannot be run."""


@dataclass
class Node:
    id: int
    module: str
    inputs: list[str]
    outputs: list[str]
    option: dict = field(default_factory=dict)
    alias: str = ""
    scheduler: int = 0
    input_manager: str = "immediate"

    def as_json(self) -> dict:
        ends = lambda names: [{"identifier": n, "alias": ""} for n in names]
        return {
            "id": self.id, "alias": self.alias, "scheduler": self.scheduler, "input_manager": self.input_manager, "option": self.option,
            "module_info": {"name": self.module, "type": "python", "path": "", "entry": ""}, "meta_info": {"premodule_id": -1, "callback_binding": []},
            "input_streams": ends(self.inputs), "output_streams": ends(self.outputs),
        }


def plain(identifier: str) -> str:
    """A stream's name without its notify part."""
    return identifier.split(":", 1)[-1]


class Graph:
    """Nodes, the graph's own inputs and outputs, options and a mode."""

    def __init__(self, option: dict | None = None, mode: str = "normal"):
        if mode not in MODES:
            raise GraphError(f"unknown mode {mode}")
        self.option, self.mode = dict(option or {}), mode
        self.nodes: list[Node] = []
        self.inputs: dict[str, DataFrame | None] = {}
        self.outputs: list[str] = []
        self.callbacks: dict[int, list[Callable[[bytes], bytes | None]]] = {}

    # building
    def input_stream(self, name: str, df: DataFrame | None = None) -> str:
        self.inputs[name] = df
        return name

    def module(self, name: str, inputs: list[str] | str = (), option: dict | None = None, *, outputs: int | list[str] = 1, alias: str = "", scheduler: int = 0, input_manager: str = "immediate") -> list[str]:
        """Add a node; the names of its outputs come back."""
        number = len(self.nodes)
        names = outputs if isinstance(outputs, list) else [f"{name}_{number}_{k}" for k in range(outputs)]
        self.nodes.append(Node(number, name, [inputs] if isinstance(inputs, str) else list(inputs), names, dict(option or {}), alias, scheduler, input_manager))
        return names

    def output_stream(self, name: str) -> None:
        self.outputs.append(name)

    def set_option(self, **option) -> None:
        self.option |= option

    def add_user_callback(self, key: int, f: Callable[[bytes], bytes | None]) -> None:
        self.callbacks.setdefault(key, []).append(f)

    def remove_user_callback(self, key: int, f: Callable[[bytes], bytes | None]) -> None:
        self.callbacks[key].remove(f)

    def clear_user_callback(self, key: int) -> None:
        self.callbacks.pop(key, None)

    def callback(self, key: int, data: bytes) -> bytes:
        """The first answer that isn't None; empty without one."""
        for f in self.callbacks.get(key, []):
            if (answer := f(data)) is not None:
                return answer
        return b""

    # JSON
    def as_json(self) -> dict:
        ends = lambda names: [{"identifier": n, "alias": ""} for n in names]
        return {"mode": self.mode, "option": self.option, "input_streams": ends(self.inputs), "output_streams": ends(self.outputs), "nodes": [n.as_json() for n in self.nodes]}

    def dump(self, path: str) -> None:
        with open(path, "w") as out:
            json.dump(self.as_json(), out, indent=2)

    @classmethod
    def from_json(cls, config: dict | str) -> Graph:
        """From a dict, a JSON text, or a file's path."""
        if isinstance(config, str):
            if config.lstrip().startswith("{"):
                config = json.loads(config)
            else:
                with open(config) as lines:
                    config = json.load(lines)
        mode = str(config.get("mode", "normal")).lower()
        graph = cls(config.get("option"), mode)
        names = lambda ends: [e["identifier"] for e in ends]
        for n in config.get("nodes", []):
            graph.nodes.append(Node(int(n["id"]), n["module_info"]["name"], names(n.get("input_streams", [])), names(n.get("output_streams", [])), n.get("option") or {}, n.get("alias", ""), n.get("scheduler", 0), n.get("input_manager", "immediate")))
        graph.inputs = dict.fromkeys(names(config.get("input_streams", [])))
        graph.outputs = names(config.get("output_streams", []))
        return graph

    # checks
    def check(self) -> list[Node]:
        """The nodes in an order in which inputs come first, or GraphError."""
        made: dict[str, int | None] = {plain(i): None for i in self.inputs}
        ids = set()
        for n in self.nodes:
            if n.id in ids:
                raise GraphError(f"node {n.id} is there twice")
            ids.add(n.id)
            for o in map(plain, n.outputs):
                if o in made:
                    raise GraphError(f"stream {o} is made twice")
                made[o] = n.id
        for n in self.nodes:
            seen = set()
            for i in map(plain, n.inputs):
                if i not in made:
                    raise GraphError(f"stream {i} of node {n.id} is not made")
                if i in seen:
                    raise GraphError(f"stream {i} goes twice into node {n.id}")
                seen.add(i)
        for o in map(plain, self.outputs):
            if o not in made:
                raise GraphError(f"output {o} is not made")
        if self.mode in ("generator",) and not self.outputs:
            raise GraphError("a generator needs an output stream")
        by_id = {n.id: n for n in self.nodes}
        order = topological({n.id: [made[plain(i)] for i in n.inputs if made[plain(i)] is not None] for n in self.nodes})
        return [by_id[k] for k in order]

    def inline(self, subgraphs: dict[str, Callable[[dict], Graph]]) -> Graph:
        """Nodes that name a sub-graph replaced by its nodes, again and again."""
        out = Graph(self.option, self.mode)
        out.inputs, out.outputs, todo = dict(self.inputs), list(self.outputs), list(self.nodes)
        number = max((n.id for n in todo), default=-1) + 1
        while todo:
            node = todo.pop(0)
            if node.module not in subgraphs:
                out.nodes.append(node)
                continue
            inner = subgraphs[node.module](node.option)
            if len(inner.inputs) != len(node.inputs) or len(inner.outputs) != len(node.outputs):
                raise GraphError(f"sub-graph {node.module} does not fit node {node.id}")
            rename = dict(zip(inner.inputs, node.inputs)) | dict(zip(inner.outputs, node.outputs))
            named = lambda s, p=f"{node.module}_{node.id}_": rename.get(s, p + s)  # noqa: B023, E731
            for n in inner.nodes:
                todo.append(Node(number, n.module, [named(i) for i in n.inputs], [named(o) for o in n.outputs], n.option, n.alias, n.scheduler, n.input_manager))
                number += 1
        return out

    def reset(self, alias: str, **option) -> None:
        """New options for the nodes of an alias; they hold from the next run on."""
        found = [n for n in self.nodes if n.alias == alias]
        if not found:
            raise GraphError(f"no node has the alias {alias}")
        for n in found:
            n.option |= option

    def remove(self, alias: str) -> None:
        """Drop the nodes of an alias and of all that only they feed."""
        gone = {n.id for n in self.nodes if n.alias == alias}
        if not gone:
            raise GraphError(f"no node has the alias {alias}")
        while True:
            lost = {o for n in self.nodes if n.id in gone for o in map(plain, n.outputs)}
            more = {n.id for n in self.nodes if n.inputs and all(plain(i) in lost for i in n.inputs)} - gone
            if not more:
                break
            gone |= more
        self.nodes = [n for n in self.nodes if n.id not in gone]
        for n in self.nodes:
            n.inputs = [i for i in n.inputs if plain(i) not in lost]
        self.outputs = [o for o in self.outputs if plain(o) not in lost]

    def update(self, other: Graph) -> None:
        """Nodes of another graph added; names must not clash."""
        number = max((n.id for n in self.nodes), default=-1) + 1
        self.nodes += [replace(n, id=number + k) for k, n in enumerate(other.nodes)]
        self.inputs |= {k: v for k, v in other.inputs.items() if k not in self.inputs}
        self.outputs += other.outputs
        self.check()

    def status(self) -> list[dict]:
        """Of each node: id, module, alias, inputs and outputs."""
        return [{"id": n.id, "module": n.module, "alias": n.alias, "inputs": n.inputs, "outputs": n.outputs} for n in self.nodes]

    # running
    def build(self, spark: SparkSession, **inputs: DataFrame) -> dict[str, DataFrame]:
        """All streams as lazy DataFrames by name."""
        streams = {plain(k): inputs.get(k, v) for k, v in self.inputs.items()}
        missing = [k for k, v in streams.items() if v is None]
        if missing:
            raise GraphError(f"no data for inputs {missing}")
        for node in self.check():
            made = run_node(spark, node, [streams[plain(i)] for i in node.inputs])
            if len(made) < len(node.outputs):
                raise GraphError(f"node {node.id} gives {len(made)} streams, not {len(node.outputs)}")
            streams |= dict(zip(map(plain, node.outputs), made))
        return streams

    def run(self, spark: SparkSession, **inputs: DataFrame) -> dict[str, DataFrame]:
        streams = self.build(spark, **inputs)
        return {o: streams[plain(o)] for o in self.outputs}

    def start(self, spark: SparkSession, **inputs: DataFrame):
        """The rows of the only output, one by one."""
        (df,) = self.run(spark, **inputs).values()
        return df.toLocalIterator(prefetchPartitions=True)


def run_node(spark: SparkSession, node: Node, inputs: list[DataFrame]) -> list[DataFrame]:
    """A node's module (by registry) or fluent method over its inputs."""
    found = registry.find(node.module)
    if isinstance(found, type) and issubclass(found, Module):
        out = found(node.option).apply(inputs)
    elif found is not None:
        out = found(spark, inputs, node.option)
    elif inputs and hasattr(Stream, node.module):
        option = dict(node.option)
        stream = Stream(inputs[0], tuple(option.pop("keys", ("stream_id",))))
        out = getattr(stream, node.module)(*[Stream(x, stream.keys) for x in inputs[1:]], **option)
    else:
        raise GraphError(f"no module {node.module}")
    out = out if isinstance(out, (list, tuple)) else [out]
    return [x.df if isinstance(x, Stream) else x for x in out]


def topological(needs: dict[int, list[int]]) -> list[int]:
    """Kahn's order, smallest first; a loop is a GraphError."""
    left = {k: set(v) for k, v in needs.items()}
    order: list[int] = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise GraphError(f"a loop through nodes {sorted(left)}")
        order += ready
        left = {k: v.difference(ready) for k, v in left.items() if k not in ready}
    return order


def edges(nodes: DataFrame) -> DataFrame:
    """From a table of nodes (id, inputs, outputs): which node feeds which, by stream."""
    made = nodes.select(F.col("id").alias("from_id"), F.explode("outputs").alias("stream"))
    used = nodes.select(F.col("id").alias("to_id"), F.explode("inputs").alias("stream"))
    return made.join(used, "stream").select("stream", "from_id", "to_id")


def to_text(graph: Graph) -> str:
    """The graph as one filter line: [in]name=args[out];..."""

    def one(n: Node) -> str:
        args = ":".join(f"{k}={n.option[k]}" for k in sorted(n.option))
        args = f"'{args}'" if "," in args else args
        return "".join(f"[{plain(i)}]" for i in n.inputs) + n.module + (f"={args}" if args else "") + "".join(f"[{plain(o)}]" for o in n.outputs)

    return ";".join(one(n) for n in graph.check())
