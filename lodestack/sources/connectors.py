"""

A client is any picklable object with the methods used here; the fakes below serve tests. ``described`` and ``parsed`` are
plain transformations; ``describing`` and ``parsing`` are calls for ``durable.write_calls``, which keep each answer and each
batch id on shared storage before they go on.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import durable

TOOL = "get_more_context"


class ParseClient(Protocol):
    def request_upload(self, name: str) -> dict[str, Any]: ...  # batch_id and url
    def upload(self, url: str, content: Iterator[bytes]) -> None: ...
    def poll(self, batch: str) -> dict[str, Any] | None: ...  # state and err_msg; None: the service doesn't know the batch
    def download(self, batch: str) -> str: ...


class VisionClient(Protocol):
    def complete(self, request: dict[str, Any]) -> dict[str, Any]: ...  # content and tool_calls


class RateLimited(Exception):
    pass


def request_of(payload: dict[str, Any], extra: dict[str, Any]) -> dict[str, Any]:
    """[S23] The payload with the configured fields; theirs win."""
    return payload | extra


def tools(up: int, down: int) -> list[dict[str, Any]]:
    """The one tool, with the limits of each direction."""
    number = lambda what, most: {"type": "integer", "minimum": 1, "maximum": most, "description": f"new lines wanted {what} what is shown, from 1 to {most}; ask for more each time"}
    return [{"type": "function", "function": {"name": TOOL, "description": "Shows lines around the image that were not shown yet.", "parameters": {"type": "object", "properties": {"more_above": number("above", up), "more_below": number("below", down)}, "required": ["more_above", "more_below"]}}}]


def chunks(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """[S22] Upload chunks."""
    for at in range(0, len(content), size):
        yield content[at : at + size]


def unless_idle(parts: Iterator[bytes], idle: float = 300.0, clock: Callable[[], float] = time.monotonic) -> Iterator[bytes]:
    """[R6] The chunks, unless their reader waits too long before it takes the next one."""
    last = clock()
    for part in parts:
        if clock() - last > idle:
            raise TimeoutError(f"nothing was uploaded for {idle:g} s")
        last = clock()
        yield part


def failure_kind(e: BaseException) -> str:
    """rate_limit, connection or api."""
    said = str(e).lower()
    if isinstance(e, RateLimited) or "429" in said or "rate" in said:
        return "rate_limit"
    if isinstance(e, (ConnectionError, TimeoutError)) or any(w in said for w in ("connect", "timeout", "handshake", "timed out")):
        return "connection"
    return "api"


def called(call: Callable[[], Any], rate_budget: int = 100, other_budget: int = 3, sleep: Callable[[float], None] = time.sleep) -> Any:
    """[R9, F28] The result of a call that may fail; the two budgets and waits are those of functions.policy. The last failure is raised."""
    rate = other = 0
    while True:
        try:
            return call()
        except Exception as e:  # noqa: BLE001  whatever a client raises is a failed call
            kind = failure_kind(e)
            if kind == "rate_limit":
                if rate >= rate_budget:
                    raise
                sleep(min(2.0 * 2.0**rate, 60.0))
                rate += 1
            else:
                if other >= other_budget:
                    raise
                sleep(2.0 if kind == "api" else min(5.0 * 2.0**other, 60.0))
                other += 1


#: [S22] How often a task is created and uploaded anew, how often in a row a poll may fail, and the pause between.
CREATE_ATTEMPTS, POLL_FAILURES, RETRY_PAUSE = 3, 100, 3.0


def submitted(client: ParseClient, name: str, raw: bytes, chunk: int = 1 << 20, idle: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """[S22] The batch id of a file that was created and uploaded; each attempt is a new task. The last failure is raised."""
    for attempt in range(1, CREATE_ATTEMPTS + 1):
        try:
            made = client.request_upload(name)
            client.upload(made["url"], unless_idle(chunks(raw, chunk), idle))
            return made["batch_id"]
        except Exception:  # noqa: BLE001  whatever a client raises is a failed attempt
            if attempt == CREATE_ATTEMPTS:
                raise
            sleep(RETRY_PAUSE)
    raise AssertionError


def _asked(client: ParseClient, batch: str, interval: float, sleep: Callable[[float], None]) -> dict[str, Any] | None:
    """A poll's answer; one that fails is made again."""
    for attempt in range(1, POLL_FAILURES + 1):
        try:
            return client.poll(batch)
        except Exception:  # noqa: BLE001
            if attempt == POLL_FAILURES:
                raise
            sleep(interval)
    raise AssertionError


def polled(client: ParseClient, batch: str, interval: float, timeout: float, sleep: Callable[[float], None]) -> tuple[str, str | None, str | None]:
    """[R4] (status, text, error) of a batch, once it ends or the time is over."""
    waited = 0.0
    while True:
        answer = _asked(client, batch, interval, sleep) or {"state": "failed", "err_msg": "unknown batch"}
        if answer["state"] == "done":
            return "done", client.download(batch), None
        if answer["state"] == "failed":
            return "fail", None, answer.get("err_msg") or "unknown error"
        if timeout and waited >= timeout:
            return "running", None, "timeout"
        sleep(interval)
        waited += interval


def remote_states(states: DataFrame, client: ParseClient, concurrency: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """[R7] Adds remote, what the service says of batches that were left open; null where none was, it isn't known, or asking goes on failing."""

    def one(status: str | None, batch: str | None) -> str | None:
        if status not in ("running", "timeout") or not batch:
            return None
        try:
            return (called(lambda: client.poll(batch), sleep=sleep) or {}).get("state")
        except Exception:  # noqa: BLE001  an unknown state is submitted again
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(remote=pd.Series([one(*x) for x in zip(b["status"], b["batch_id"])], dtype=object, index=b.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema)
    return states.repartition(concurrency).mapInPandas(run, f"{fields}, remote string")


@dataclass(frozen=True)
class Waits:
    """[R4, R6, S22] How a parse service is asked and fed."""

    interval: float = 3.0
    timeout: float = 0.0
    chunk: int = 1 << 20
    idle: float = 300.0
    sleep: Callable[[float], None] = time.sleep


PARSED = "name string, status string, batch_id string, text string, error string"


def _parse(client: ParseClient, waits: Waits, name: str, raw: bytes, action: str, batch: str | None, began: Callable[[str], None] = lambda batch: None) -> tuple:
    """[R7] PARSED of a file. began is told of a new batch before it is polled."""
    if action == "skip":
        return name, "skip", batch, None, None
    try:
        if action in ("submit", "resubmit"):
            batch = submitted(client, name, raw, waits.chunk, waits.idle, waits.sleep)
            began(batch)
        if action == "download":
            return name, "done", batch, client.download(batch), None
        status, text, error = polled(client, batch, waits.interval, waits.timeout, waits.sleep)
        return name, status, batch, text, error
    except Exception as e:  # noqa: BLE001  one file's failure is its outcome, not the job's
        return name, "fail", batch, None, str(e)[:200]


def parsed(files: DataFrame, client: ParseClient, interval: float = 3.0, timeout: float = 0.0, concurrency: int = 5, chunk: int = 1 << 20, idle: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """[S22, R4, R6, R7] PARSED, the status one of done, skip, fail and running, of files(name, content[, action, batch_id]).

    Without an action a file is submitted; actions are those of policy.resume_action. Partitions are the concurrency.
    """
    waits = Waits(interval, timeout, chunk, idle, sleep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in zip(b["name"], b["content"], b["action"], b["batch_id"]):
                yield pd.DataFrame([_parse(client, waits, *row)], columns=["name", "status", "batch_id", "text", "error"])

    have = files.columns
    action = F.col("action") if "action" in have else F.lit("submit").alias("action")
    batch = F.col("batch_id") if "batch_id" in have else F.lit(None).cast("string").alias("batch_id")
    return files.select("name", "content", action, batch).repartition(concurrency).mapInPandas(run, PARSED)


def parsing(client: ParseClient, states: str, output: str, run: str, waits: Waits = Waits()) -> durable.Call:
    """[R7, K13] A call of rows(name, stem, state, content, action, batch_id): what ``parsed`` does, kept at each step.

    ``<states>/<state>`` has the batch id before the first poll and each change after; the text is in ``<output>/<stem>/full.md``
    before the state says done; ``<states>/_runs/<run>/<state>`` is the outcome. A row whose task runs again ends at once if it
    has an outcome, and goes on with the batch that it began.
    """
    kept, texts = durable.Store(states), durable.Store(output)

    def call(row: Any) -> None:
        outcome = f"_runs/{run}/{row.state}"
        if kept.has(outcome):
            return
        action, batch, created = row.action, row.batch_id, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")
        before = kept.get_json(row.state) or {}
        if action in ("submit", "resubmit") and before.get("run") == run and before.get("status") == "running":
            action, batch = "poll", before["batch_id"]

        def state(status: str, batch: str | None, error: str | None) -> None:
            kept.put_json(row.state, {"file": row.name, "batch_id": batch, "created_at": before.get("created_at") if action == "poll" and before else created, "status": status, "last_error": error or "", "output_folder": row.stem, "run": run})

        _, status, batch, text, error = _parse(client, waits, row.name, row.content, action, batch, lambda new: state("running", new, None))
        if status == "done":
            texts.put(f"{row.stem}/full.md", (text if text.endswith("\n") else text + "\n").encode("utf-8", "surrogatepass"))
        if status != "skip":
            state("failed" if status == "fail" else status, batch, error)
        kept.put_json(outcome, {"name": row.name, "status": status, "batch_id": batch, "error": error})

    return call


@dataclass(frozen=True)
class Limits:
    """How far the first frame reaches, how far one request may grow it, rounds with tools, repairs of the format, and budgets."""

    start: tuple[int, int] = (30, 30)
    most: tuple[int, int] = (200, 200)
    rounds: int = 3
    fixes: int = 1
    rate_budget: int = 100
    other_budget: int = 3

    def reach(self) -> tuple[int, int]:
        """Lines above and below an image that any conversation can get to."""
        return tuple(a + self.rounds * b for a, b in zip(self.start, self.most))

    @classmethod
    def of(cls, options: dict[str, Any]) -> Limits:
        return cls(
            (options["window_up"], options["window_down"]), (options["max_window_up"], options["max_window_down"]),
            options["max_retries"], options["format_fix_attempts"], options["rate_limit_retries"], options["api_max_retries"],
        )


class Conversation:
    """[R8] One image's talk with the model: rounds with tools, one without, a last request, and a repair of the format."""

    def __init__(self, client: VisionClient, model: str, prompt: str, extra: dict[str, Any], limits: Limits, sleep: Callable[[float], None] = time.sleep):
        self.client, self.model, self.prompt, self.extra, self.limits, self.sleep = client, model, prompt, extra, limits, sleep
        self.requests, self.asked = 0, []

    def _ask(self, messages: list[dict[str, Any]], **more: Any) -> dict[str, Any]:
        self.requests += 1
        payload = {"model": self.model, "messages": messages} | more
        return called(lambda: self.client.complete(request_of(payload, self.extra)), self.limits.rate_budget, self.limits.other_budget, self.sleep)

    def _opened(self, image: str, text: str) -> list[dict[str, Any]]:
        parts = [{"type": "text", "text": text}, {"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{image}"}}]
        return [{"role": "system", "content": self.prompt}, {"role": "user", "content": parts}]

    def answer(self, image: str, lines: list[str], at: int) -> str:
        up, down = self.limits.start
        shown = "\n".join(marked(lines, at, max(0, at - up), at + down + 1))
        messages = self._opened(image, f"Line {at} holds the image. Around it:\n{shown}\nDescribe the image; {TOOL} shows more lines.")
        for turn in range(self.limits.rounds + 1):
            free = turn < self.limits.rounds
            said = self._ask(messages, **({"tools": tools(*self.limits.most), "tool_choice": "auto"} if free else {"tool_choice": "none"}))
            calls = said.get("tool_calls") or []
            if not calls:
                return text_of(said.get("content"))
            messages.append({"role": "assistant", "tool_calls": calls})
            for c in calls:
                wanted = arguments_of(c)
                if wanted is None:
                    continue
                self.asked.append(wanted)
                grown_up, grown_down = (now + min(more, most) for now, more, most in zip((up, down), wanted, self.limits.most))
                fresh = marked(lines, at, max(0, at - grown_up), max(0, at - up)) + marked(lines, at, at + down + 1, at + grown_down + 1)
                up, down = grown_up, grown_down
                messages.append({"role": "tool", "tool_call_id": c.get("id"), "content": "\n".join(fresh) or "There are no more lines."})
        messages.append({"role": "user", "content": "No more lines can be shown. Describe the image now."})
        return text_of(self._ask(messages).get("content"))

    def repaired(self, image: str, before: str) -> str:
        """One request that shows the answer and what it lacks."""
        said = self._ask(self._opened(image, f"This answer lacks the tag {P.TYPE_TAG} type] at its start:\n{before}\nGive it again, the tag first and nothing else before it."))
        return text_of(said.get("content"))

    def result(self, image: str | None, path: str, lines: list[str], at: int) -> tuple[str, str]:
        """(result, status); policy.normalised_result is the same rule as a column."""
        if image is None:
            return f"[IMG_MISSING: {path}]", "error"
        try:
            said = self.answer(image, lines, at).strip() or P.EMPTY_RESPONSE
            if P.TYPE_TAG in said:
                return said[said.index(P.TYPE_TAG) :].strip(), "ok"
            if said.startswith(P.RESULT_TAG):
                return said, "error"
            fixed = self.repaired(image, said) if self.limits.fixes > 0 else ""
        except Exception as e:  # noqa: BLE001  a call that failed beyond its budget is the image's result
            return {"rate_limit": P.RATE_LIMITED, "connection": P.NO_CONNECTION}.get(failure_kind(e), f"[IMG_API_ERROR: {str(e)[:200]}]"), "error"
        if P.TYPE_TAG in fixed:
            return fixed[fixed.index(P.TYPE_TAG) :].strip(), "ok"
        return P.INVALID_RESPONSE, "retry"


def text_of(content: Any) -> str:
    """A message's content: text as it is, nothing as empty, anything else as JSON."""
    return content if isinstance(content, str) else "" if content is None else json.dumps(content, ensure_ascii=False)


def arguments_of(tool_call: dict[str, Any]) -> tuple[int, int] | None:
    """[E12] The lines a tool call asks for; None if it is another tool's or can't be read."""
    if tool_call.get("name", TOOL) != TOOL:
        return None
    try:
        args = json.loads(tool_call["arguments"])
        return int(args["more_above"]), int(args["more_below"])
    except (ValueError, KeyError, TypeError):
        return None


def marked(lines: list[str], at: int, first: int, last: int) -> list[str]:
    """[W3] Lines first to last, its end exclusive, with their numbers."""
    return [f"{'>>>[IMG]' if k == at else f'[L{k}]'} {lines[k]}" for k in range(first, min(last, len(lines)))]


RESULTS = "key string, result string, status string, requests long, asked array<struct<more_above:long,more_below:long>>, thread long, started double, elapsed double"


@dataclass(frozen=True)
class Model:
    """[S23] The service and how it is asked."""

    client: VisionClient
    name: str = "model"
    prompt: str = ""
    extra: dict[str, Any] = field(default_factory=dict)
    limits: Limits = Limits()
    sleep: Callable[[float], None] = time.sleep

    def describe(self, row: Any) -> dict[str, Any]:
        """RESULTS of a task(key, path, image as base64 or null, lines, line_at)."""
        from pyspark import TaskContext

        talk, began = Conversation(self.client, self.name, self.prompt, self.extra, self.limits, self.sleep), time.time()
        result, status = talk.result(row.image, row.path, list(row.lines), int(row.line_at))
        asked = [{"more_above": a, "more_below": z} for a, z in talk.asked]
        return {"key": row.key, "result": result, "status": status, "requests": talk.requests, "asked": asked, "thread": TaskContext.get().partitionId() + 1, "started": began, "elapsed": time.time() - began}


def described(tasks: DataFrame, client: VisionClient, model: str, prompt: str, extra: dict[str, Any] | None = None, limits: Limits = Limits(), concurrency: int = 10, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """[S23, R8, R9] RESULTS of tasks(key, path, image as base64 or null, lines, line_at); partitions are the concurrency."""
    asked = Model(client, model, prompt, extra or {}, limits, sleep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 100):  # a frame for each answer takes longer than what else is done for it
                some = [asked.describe(r) for r in b[a : a + 100].itertuples(index=False)]
                yield pd.DataFrame([tuple(one.values()) for one in some], columns=list(some[0]))

    return tasks.select("key", "path", "image", "lines", "line_at").repartition(concurrency).mapInPandas(run, RESULTS)


def describing(model: Model, progress: str, run: str) -> durable.Call:
    """[K4, R8] A call of rows(key, item, path, image, lines, line_at, start, end): what ``described`` does, kept before the next begins.

    ``<progress>/<item>`` is the item, unless its result is one to be retried [F26]; ``<progress>/_runs/<run>/<md5 of the key>`` is
    what the run's log and counts are made of. A row whose task runs again ends at once if it has the latter.
    """
    kept = durable.Store(progress)

    def call(row: Any) -> None:
        outcome = f"_runs/{run}/{hashlib.md5(row.key.encode('utf-8', 'surrogatepass')).hexdigest()}.json"
        if kept.has(outcome):
            return
        one = model.describe(row)
        if one["status"] != "retry":
            kept.put_json(row.item, {"key": row.key, "result": one["result"], "start": row.start, "end": row.end, "img_path": row.path})
        kept.put_json(outcome, one)

    return call


@dataclass
class FakeParser:
    """Says running for so many polls, then done; names in failing fail, and batches in lost aren't known."""

    polls: int = 2
    failing: tuple[str, ...] = ()
    lost: tuple[str, ...] = ()
    seen: dict[str, int] = field(default_factory=dict)
    got: dict[str, bytes] = field(default_factory=dict)

    def request_upload(self, name: str) -> dict[str, Any]:
        return {"batch_id": f"batch-{name}", "url": f"fake://{name}"}

    def upload(self, url: str, content: Iterator[bytes]) -> None:
        self.got[url] = b"".join(content)

    def poll(self, batch: str) -> dict[str, Any] | None:
        if batch in self.lost:
            return None
        self.seen[batch] = self.seen.get(batch, 0) + 1
        if batch.removeprefix("batch-") in self.failing:
            return {"state": "failed", "err_msg": "broken"}
        return {"state": "done" if self.seen[batch] > self.polls else "running"}

    def download(self, batch: str) -> str:
        return f"# {batch}"


@dataclass
class FakeVision:
    """Asks for context so many times, even when it can't, then answers; without the tag until it is told if ``plain``."""

    asks: int = 1
    plain: bool = False

    def complete(self, request: dict[str, Any]) -> dict[str, Any]:
        asked = sum(m["role"] == "tool" for m in request["messages"])
        told = "lacks the tag" in str(request["messages"][-1]["content"])
        if asked < self.asks and "tool_choice" in request:
            return {"tool_calls": [{"id": "1", "name": TOOL, "arguments": '{"more_above": 5, "more_below": 500}'}]}
        return {"content": f"seen {asked}" if self.plain and not told else f"so: [IMG_TYPE: text] {asked}"}
