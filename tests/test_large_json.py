"""One JSON document in byte ranges against the reader of whole documents."""

import io
import json
import random

import pytest

from skeinwork.sources import json_ranges
from skeinwork.sources.graph_json import read_graph

NASTY = ['{"', '"}],', "\\", '\\"', "[[{", "}", "é ", '", "nodes": [{', "a\nb", "", '{"id": "x"}']


def random_document(seed):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choices(NASTY, k=rng.randrange(3)))
    nodes = [{"id": f"n{i}", "label": say(), "type": say(), "more": {"list": [1, [2, say()], {}], say(): None}} for i in range(rng.randrange(5))]
    edges = [{"source": say(), "target": "t", "relationship": say()} for _ in range(rng.randrange(4))]
    document = {"metadata": {"nodes": [1, {"id": "not one"}], "text": say()}, "directed": True, "note": rng.choice(["nodes", "edges", say()])}
    document |= dict(rng.sample([("nodes", nodes), (rng.choice(["edges", "links"]), edges)], 2))
    if seed % 3 == 0:
        document["links"] = [{"source": "other", "target": "other"}]
    document["tail"] = [[{"source": 1}], "links"]
    return json.dumps(document, ensure_ascii=bool(seed % 2), indent=rng.choice([None, 1]))


def sections(data, size, monkeypatch):
    """What ranges of a size give, put together without Spark."""
    monkeypatch.setattr(json_ranges, "_by_range", lambda spark, path, ranges, task: [json.loads(json.dumps(task(io.BytesIO(data), r))) for r in ranges])
    monkeypatch.setattr(json_ranges, "_open_file", lambda path: Sized(data))
    found = json_ranges.plan(None, "x", size)
    if found is None:
        return None
    ranges, keys = found
    out = [e for r in ranges for e in json_ranges.elements(json_ranges.Window(io.BytesIO(data), r["at"], r["length"]), r["length"], r["state"], r["depth"], r["section"], r["last"])]
    assert [at for _, at, _ in out] == sorted(at for _, at, _ in out)
    return {s: [json.loads(x) for name, _, x in out if name == s] for s in json_ranges.SECTIONS}, keys


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("more", [1, 1 << 20])
@pytest.mark.parametrize("seed", range(6))
def test_cut_anywhere(monkeypatch, seed, more):
    """Every length of range, so that cuts lie at every byte; past the end of a range a byte or everything is read at a time."""
    monkeypatch.setattr(json_ranges, "MORE_BYTES", more)
    text = random_document(seed)
    data, whole = text.encode(), json.loads(text)
    for size in [*range(1, len(data) + 1, 1 if more > 1 else 13), len(data) + 5]:
        found, keys = sections(data, size, monkeypatch)
        assert keys == set(whole)
        assert all(found[s] == whole.get(s, []) for s in json_ranges.SECTIONS), size


def test_broken_documents(monkeypatch):
    for text in ("", "[]", '["nodes", [{"id": 1}]]', '{"nodes": [{"id": "a}]}', '{"nodes": [{]}', '{"nodes": [}'):
        assert sections(text.encode(), 4, monkeypatch) is None or text == '{"nodes": [{]}'
    found, keys = sections(b' {"nodes": null, "edges": {"a": [1]}, "links": [ ], "x": "links"}', 3, monkeypatch)
    assert found == {"nodes": [], "edges": [], "links": []} and keys == {"nodes", "edges", "links", "x"}


def facts(graph):
    plain = lambda r: tuple(json.dumps(json.loads(v), sort_keys=True) if k == "attrs" else v for k, v in r.asDict().items() if k != "pos")
    return [plain(r) for r in graph.nodes.orderBy("pos").collect()], [plain(r) for r in graph.edges.orderBy("pos").collect()]


def test_read_large_graph(spark, tmp_path):
    document = json.loads(random_document(1))
    document["nodes"] = [{"id": f"n{i}", "file_type": 'co"de', "label": "{" * (i % 3)} for i in range(3000)]
    document.pop("links", None)
    document["edges"] = [{"source": f"n{i}", "target": f"n{i + 1}", "relation": "calls"} for i in range(2999)]
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(document))
    got = json_ranges.read_large_graph(spark, str(path), 20_000)
    assert got.nodes.rdd.getNumPartitions() > 5
    assert facts(got) == facts(read_graph(spark, str(path)))
    assert facts(json_ranges.read_large_graph(spark, f"file://{path}")) == facts(got)
    with pytest.warns(UserWarning, match="no graph"):
        assert json_ranges.read_large_graph(spark, str(tmp_path / "none.json")).nodes.count() == 0
