"""The tools of an assistant over notes, and the loop that drives them. The model is a function given by the caller."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds that work which was told to stop is waited for.
GRACE = 10
MOST_STEPS = 50
READ_ONLY = {"read_note", "list_files", "glob", "grep", "search_vault"}
#: Reads are allowed, changes are asked for.
PERMISSIONS = {name: "allow" for name in READ_ONLY} | {name: "ask" for name in ("write_note", "append_note", "edit_note", "delete_note")}


class ToolError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def require(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ToolError("INVALID_ARGS", f"{name} must be a text that isn't empty")
    return value


@dataclass
class Tools:
    """Tools by name; a later one of the same name takes the place of the earlier."""

    found: dict[str, Callable[[dict], Any]] = field(default_factory=dict)

    def register(self, name: str, run: Callable[[dict], Any]) -> None:
        self.found[name] = run

    def names(self) -> list[str]:
        return list(self.found)

    def is_read_only(self, name: str) -> bool:
        return name in READ_ONLY

    def execute(self, name: str, args: dict) -> Any:
        if name not in self.found:
            raise ToolError("UNKNOWN_TOOL", name)
        return self.found[name](args)


@dataclass
class Gate:
    """Permissions of one session: trust, then what the session was granted, then the setting, then the user."""

    settings: dict[str, str] = field(default_factory=lambda: dict(PERMISSIONS))
    trust: bool = False
    confirm: Callable[[str, dict], str] = lambda name, args: "deny"
    grants: set[str] = field(default_factory=set)

    def allows(self, name: str, args: dict) -> bool:
        key = f"{name}:{args['path']}" if isinstance(args.get("path"), str) and args["path"] else name
        if self.trust or key in self.grants:
            return True
        setting = self.settings.get(name, "ask")
        if setting != "ask":
            return setting == "allow"
        answer = self.confirm(name, args)
        if answer == "session":
            self.grants.add(key)
        return answer in ("allow", "session")


def hooks_deny(hooks: Iterable[Callable[[str, dict], str | None]], name: str, args: dict) -> str | None:
    """The first hook's reason to deny. A hook that fails is passed over."""
    for hook in hooks:
        try:
            reason = hook(name, args)
        except Exception:  # noqa: BLE001  hooks are open on failure
            continue
        if reason:
            return reason
    return None


class Cancelled(RuntimeError):
    pass


def limited(spark: SparkSession, seconds: float | None = None, cancelled: Callable[[], bool] = lambda: False, every: float = 0.05) -> Callable[[Callable[[], Any]], Any]:
    """A function that runs work() and stops its Spark jobs after `seconds` (TimeoutError) or when cancelled() is true
    (Cancelled). Jobs are known by a tag, also those that work starts after it was stopped; other work goes on."""
    context = spark.sparkContext

    def within(work: Callable[[], Any]) -> Any:
        tag, made, until = f"quirebook-{uuid.uuid4().hex}", {}, time.monotonic() + (seconds if seconds is not None else math.inf)

        def tagged() -> None:
            context.addJobTag(tag)
            try:
                made["result"] = work()
            except BaseException as error:  # noqa: BLE001  is raised below
                made["error"] = error
            finally:
                context.removeJobTag(tag)

        thread = InheritableThread(target=tagged, daemon=True)
        thread.start()
        stopped = None
        while thread.is_alive():
            thread.join(every)
            now = time.monotonic()
            if thread.is_alive() and stopped is None and (cancelled() or now > until):
                stopped, until = Cancelled("cancelled") if cancelled() else TimeoutError(f"stopped after {seconds} seconds"), now + GRACE
            if thread.is_alive() and stopped:
                context.cancelJobsWithTag(tag)
                if now > until:
                    break  # work outside of Spark can't be stopped, but isn't waited for
        if stopped:
            raise stopped
        if "error" in made:
            raise made["error"]
        return made["result"]

    return within


def run(model: Callable[[list[dict]], dict], tools: Tools, message: str, gate: Gate | None = None, hooks: Iterable[Callable] = (), steps: int = MOST_STEPS, cancelled: Callable[[], bool] = lambda: False, within: Callable[[Callable[[], Any]], Any] = lambda work: work()) -> Iterator[dict]:
    """Events of one answer. model(messages) gives {"text", "calls": [(id, name, args)], "finish"}; calls run in order,
    and their results go back to it until it asks for none. There is always one last `end`, with the messages to save.
    Model and tools run by within(work), see `limited`."""
    gate, messages = gate or Gate(), [{"role": "user", "content": message}]
    yield {"type": "start"}
    for step in range(steps + 1):
        if cancelled():
            yield {"type": "error", "code": "CANCELLED"}
            break
        if step == steps:
            yield {"type": "notice", "text": "step limit"}
            yield {"type": "error", "code": "STEP_LIMIT"}
            break
        try:
            answer = within(lambda: model(messages))
        except Cancelled:
            yield {"type": "error", "code": "CANCELLED"}
            break
        except TimeoutError as error:
            yield {"type": "error", "code": "TIMEOUT", "message": str(error)}
            break
        except Exception as error:  # noqa: BLE001
            yield {"type": "error", "code": "LLM_ERROR", "message": str(error)}
            break
        if answer.get("text"):
            yield {"type": "delta", "text": answer["text"]}
        calls = answer.get("calls") or []
        messages.append({"role": "assistant", "content": answer.get("text", ""), "calls": calls})
        if answer.get("finish") == "length":
            yield {"type": "error", "code": "TRUNCATED"}
            if not calls:
                break
        if not calls:
            break
        for call_id, name, args in calls:
            yield {"type": "call", "id": call_id, "name": name, "args": args}
            denied = None if gate.allows(name, args) else "no permission"
            denied = denied or hooks_deny(hooks, name, args)
            result: Any
            if denied:
                yield {"type": "error", "code": "TOOL_DENIED", "message": denied}
                result = {"error": denied}
            else:
                try:
                    result = within(lambda name=name, args=args: tools.execute(name, args))
                except TimeoutError as error:
                    yield {"type": "error", "code": "TIMEOUT", "message": str(error)}
                    result = {"error": str(error)}
                except Exception as error:  # noqa: BLE001
                    yield {"type": "error", "code": getattr(error, "code", "TOOL_ERROR"), "message": str(error)}
                    result = {"error": str(error)}
                yield {"type": "result", "id": call_id, "name": name, "result": result}
                if name == "search_vault" and "error" not in (result if isinstance(result, dict) else {}):
                    yield {"type": "search", "results": result}
            messages.append({"role": "tool", "id": call_id, "name": name, "content": result})
    yield {"type": "end", "messages": messages}
