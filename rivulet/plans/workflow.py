"""Import of node-and-link workflow JSON as a graph.

A workflow is {id: {"class_type": name, "inputs": {input: value or [id, port]}}}.
Links become streams, other inputs options; a node of two or more linked inputs
aligns them frame by frame, others take them as they come.
"""

from __future__ import annotations

import json

from rivulet.plans.graph import Graph, GraphError, Node, topological


def _is_link(value, known) -> bool:
    return isinstance(value, list) and len(value) == 2 and str(value[0]) in known and isinstance(value[1], int)


def read(workflow: dict | str) -> Graph:
    nodes = json.loads(workflow) if isinstance(workflow, str) else workflow
    nodes = {str(k): v for k, v in nodes.items()}
    links = {k: {n: (str(v[0]), v[1]) for n, v in node["inputs"].items() if _is_link(v, nodes)} for k, node in nodes.items()}
    number = {k: i for i, k in enumerate(nodes)}
    order = topological({number[k]: [number[a] for a, _ in v.values()] for k, v in links.items()})
    names, graph = list(nodes), Graph(mode="generator")
    ports: dict[str, int] = dict.fromkeys(nodes, 1)
    for v in links.values():
        for a, port in v.values():
            ports[a] = max(ports[a], port + 1)
    for i in order:
        k = names[i]
        option = {n: v for n, v in nodes[k]["inputs"].items() if n not in links[k]}
        inputs = [f"stream_{a}_{port}" for a, port in links[k].values()]
        outputs = [f"stream_{k}_{port}" for port in range(ports[k])]
        graph.nodes.append(Node(i, nodes[k]["class_type"], inputs, outputs, option, k, 0, "framesync" if len(inputs) > 1 else "default"))
    used = {s for n in graph.nodes for s in n.inputs}
    graph.outputs = [s for n in graph.nodes for s in n.outputs if s not in used]
    if not graph.outputs:
        raise GraphError("a workflow needs an end")
    return graph
