"""Transcript trees that the tests write: a pottery workshop's projects, with the cases this reader has rules for."""

import json
from pathlib import Path

COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
OPUS, SONNET, HAIKU = "claude-opus-4-5", "claude-sonnet-4-5", "claude-haiku-4-5"
GLAZE, BENCH = "/srv/pots/glaze", "/home/mo/bench"


class Session:
    """The lines of one file, in order; ``at`` is a clock time on 3 March 2025, UTC."""

    def __init__(self, name):
        self.name, self.lines = name, []

    def raw(self, text):
        self.lines.append(text)
        return self

    def add(self, kind, at=None, **fields):
        stamp = {"timestamp": f"2025-03-03T{at}Z"} if at else {}
        return self.raw(json.dumps({"type": kind, "sessionId": self.name} | stamp | fields))

    def ask(self, content, at=None):
        return self.add("user", at, message={"content": content})

    def answer(self, *blocks, at=None, model=SONNET, used=(0, 0, 0, 0), stop="end_turn", **usage):
        message = {"model": model, "stop_reason": stop, "usage": dict(zip(COUNTERS, used)) | usage, "content": list(blocks)}
        return self.add("assistant", at, message=message)

    def turn(self, ms, at=None):
        return self.add("system", at, subtype="turn_duration", durationMs=ms)

    def save(self, root: Path, project: str) -> Path:
        path = root / project / f"{self.name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(self.lines) + "\n")
        return path


def text(words):
    return {"type": "text", "text": words}


def use(tool, **given):
    return {"type": "tool_use", "name": tool, "id": "u9", "input": given}


THOUGHT = {"type": "thinking", "thinking": "hm"}


def workshop(root: Path) -> Path:
    """Five sessions: two of a project (one in a work tree), one undated, one of a hidden folder, one of questions only."""
    (
        Session("5e7a10c4-kiln")
        .ask("mix a celadon glaze", at="08:00:00")
        .answer(text("measuring"), use("Weigh", grams=40), THOUGHT, at="08:00:20", model=HAIKU, used=(120, 30, 8, 0), service_tier="flex", inference_geo="eu")
        .answer(use("Weigh"), use("Stir"), THOUGHT, at="08:00:40", model=HAIKU, used=(80, 10, 0, 64), service_tier="flex, rush", stop="tool_use")
        .answer(text("Glazes are stirred"), at="08:01:00", used=(700, 90, 0, 0), speed=1.5, iterations=4)
        .turn(1200, at="08:01:01").turn(800, at="08:01:02").turn(3000, at="08:01:03")
        .add("system", "08:01:04", subtype="note", durationMs=250)
        .add("file-history-snapshot", snapshot={"trackedFileBackups": {"recipes/celadon.md": {}, "log.txt": None}})
        .add("file-history-snapshot", snapshot={"trackedFileBackups": {"recipes/celadon.md": {}}})
        .add("pr-link", "08:02:00", prNumber=31, prUrl="https://forge/pots/31", prRepository="pots")
        .add("attachment", filename="swatch.png", mimeType="image/png").add("attachment", filename="")
        .save(root, "-srv-pots-glaze")
    )
    (
        Session("5e7a77b2-tree")
        .ask([text("try ash"), {"type": "tool_result", "tool_use_id": "u9", "content": [text("grey")]}], at="09:00:00")
        .answer(text("ash is stirred in"), at="09:01:30", used=(40, 5, 0, 900), inference_geo="us")
        .add("file-history-snapshot", snapshot={"trackedFileBackups": {"recipes/celadon.md": {}}})
        .add("pr-link", "09:05:00", prNumber=31, prUrl="https://forge/pots/31", prRepository="pots")
        .add("pr-link", "09:06:00", prNumber=4)
        .save(root, "-srv-pots-glaze--claude-worktrees-ash")
    )
    (
        Session("b0d1e6-undated")
        .raw("").raw("{broken").raw('["a", "list"]')
        .answer(use("Fire"), use("Fire"), use("Fire"), model=OPUS, used=(10, 2, 1, 3)).turn(70)
        .add("permission-mode", mode="plan").add("permission-mode", mode="")
        .save(root, "-home-mo-bench")
    )
    Session("77cafe-cache").answer(text("nothing used"), at="07:00:00", model=OPUS).turn(2000).save(root, "-home-mo-bench--cache")
    Session("e9-questions").ask("is it hot", at="11:00:00").ask("", at="11:00:09").save(root, "-home-mo-bench")
    return root
