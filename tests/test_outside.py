import io
import json

import pytest

from loamline import __main__ as cli
from loamline import agents, serve


def test_agent_files(tmp_path):
    (tmp_path / "AGENTS.md").write_text("# Mine\n")
    for _ in range(2):
        files = agents.install(tmp_path, "codex")
    text = files[0].read_text()
    assert text.startswith("# Mine\n\n") and text.count(agents.START) == 1 and files[1].exists()
    assert agents.install(tmp_path, "claude")[0].name == "CLAUDE.md"
    with pytest.raises(ValueError, match="agent"):
        agents.install(tmp_path, "other")


def test_block_with_backslashes(tmp_path):
    at = tmp_path / "x.md"
    agents.upsert_block(at, r"a\1")
    agents.upsert_block(at, r"b\g<0>")
    assert r"b\g<0>" in at.read_text() and r"a\1" not in at.read_text()


def call(tools, *messages):
    sink = io.StringIO()
    serve.run(tools, io.StringIO("".join(m if isinstance(m, str) else json.dumps(m) + "\n" for m in messages)), sink)
    return [json.loads(x) for x in sink.getvalue().splitlines()]


def test_serve():
    tools = {"ask": lambda query, limit=8, target=None: f"{query} {limit}", "inspect": lambda query=None: "all"}
    ask = lambda args: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "ask", "arguments": args}}
    got = call(tools, {"jsonrpc": "2.0", "id": 0, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, ask({"query": "x", "limit": 3}), ask({}), ask({"query": "x", "limit": 0}), ask({"query": 1}), "nonsense\n", {"jsonrpc": "2.0", "id": 9, "method": "what"})
    assert got[0]["result"]["serverInfo"]["name"] == "loamline" and len(got[1]["result"]["tools"]) == 2
    assert got[2]["result"]["content"][0]["text"] == "x 3"
    assert [g["result"]["isError"] for g in got[3:6]] == [True, True, True]
    assert got[6]["error"]["code"] == -32700 and got[7]["error"]["code"] == -32601


def test_options():
    p = cli.parser()
    assert p.parse_args(["ask", "x", "--limit", "3"]).limit == 3
    for bad in (["ask", "x", "--limit", "0"], ["index", "--backend", "other"], ["agents", "x"], []):
        with pytest.raises(SystemExit):
            p.parse_args(bad)


def test_errors_end_with_one(tmp_path, capsys):
    assert cli.main(["--vault", str(tmp_path), "status"]) == 1
    assert "FileNotFoundError" in capsys.readouterr().err
