"""python -m rivulet COMMAND ...

run GRAPH.json OUT [input=path.parquet ...]   run a graph from JSON, an output folder for each stream
trace LOG OUT                                 duration, frequency and total tables of an event log
modules                                       names of registered modules
text GRAPH.json                               the graph as one filter line
new NAME FILE.py                              a user module to start from
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from rivulet.operators import trace
from rivulet.plans.graph import Graph, to_text
from rivulet.plans.modules import registry


MODULE = '''"""A user module."""

from rivulet.plans.modules import Module, registry


@registry.add("{name}")
class {cls}(Module):
    schema = ""  # of what process yields; empty: as the input

    def process(self, frames):
        for pdf in frames:
            yield pdf
'''


def main(args: list[str]) -> None:
    match args:
        case ["run", graph, out, *inputs]:
            spark = SparkSession.builder.getOrCreate()
            frames = {k: spark.read.parquet(v) for k, v in (x.split("=", 1) for x in inputs)}
            for name, df in Graph.from_json(graph).run(spark, **frames).items():
                df.write.parquet(f"{out}/{name}")
        case ["trace", log, out]:
            spark = SparkSession.builder.getOrCreate()
            events = trace.parse(spark.read.text(log))
            for name, df in (("durations", trace.durations(events)), ("frequencies", trace.frequencies(events)), ("totals", trace.totals(events))):
                df.write.json(f"{out}/{name}")
        case ["modules"]:
            print("\n".join(registry.names()))
        case ["text", graph]:
            print(to_text(Graph.from_json(graph)))
        case ["new", name, path]:
            with open(path, "x") as out:
                out.write(MODULE.format(name=name, cls="".join(part.title() for part in name.split("_"))))
        case _:
            sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
