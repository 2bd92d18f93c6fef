"""A tokenizer behind HTTP as a map over documents: POST {svg} gives {token_ids}, POST {token_ids} gives {svg}.

Each task has at most in_flight requests open, so a cluster has as many times that as it has task
slots. A request that fails in transit, or with 429 or 5xx, is made again after a growing pause, until
attempts or the deadline of its document are used up. What fails then is the row's error; the job
goes on. A task that runs again asks again: the service must bear a document twice.

A service that takes many documents a request is asked for batch of them at once: POST {items: [{svg}, ...]}
gives {items: [{token_ids} or {status}, ...]}, by place, and likewise back. What is put off with a
status of AGAIN is asked again without the others; each item fails for itself.

Defined results: a null document gives nulls and no request; an answer that isn't of the agreed form
is an error that is not asked again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

AGAIN = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Remote:
    """Where a tokenizer is, and how it is asked."""

    tokenize_url: str
    detokenize_url: str
    timeout: float = 30.0
    attempts: int = 4
    pause: float = 0.2
    deadline: float = 120.0
    in_flight: int = 8
    batch: int = 1

    def post(self, url: str, payload: dict, until: float) -> dict:
        body = json.dumps(payload).encode()
        for k in range(self.attempts):
            try:
                ask = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(ask, timeout=max(0.01, min(self.timeout, until - time.monotonic()))) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                last, again = f"HTTP {e.code}", e.code in AGAIN
            except OSError as e:  # in transit
                last, again = f"no answer: {getattr(e, 'reason', e)}", True
            wait = self.pause * 2**k
            if not again or k == self.attempts - 1 or time.monotonic() + wait > until:
                raise RuntimeError(last)
            time.sleep(wait)
        raise RuntimeError("no attempts")

    def both(self, svg: str | None) -> tuple[list[int] | None, str | None, str | None]:
        """token_ids, what they decode to, error."""
        if svg is None:
            return None, None, None
        until, ids = time.monotonic() + self.deadline, None
        try:
            ids = [int(t) for t in self.post(self.tokenize_url, {"svg": svg}, until)["token_ids"]]
            back = self.post(self.detokenize_url, {"token_ids": ids}, until)["svg"]
            if not isinstance(back, str):
                raise TypeError("svg is no text")
            return ids, back, None
        except RuntimeError as e:
            return ids, None, str(e)
        except (ValueError, KeyError, TypeError) as e:
            return ids, None, f"unlike an answer: {type(e).__name__}"

    def post_all(self, url: str, payloads: list[dict], until: float) -> list[dict | str]:
        """The answer to each of payloads, or what failed; those that are put off are asked again together."""
        out: list[dict | str] = ["no attempts"] * len(payloads)
        todo = list(range(len(payloads)))
        for k in range(self.attempts):
            # One attempt: what is asked again is for this loop, item by item.
            once = replace(self, attempts=1)
            try:
                got = once.post(url, {"items": [payloads[i] for i in todo]}, until)["items"]
                if not isinstance(got, list) or len(got) != len(todo):
                    raise TypeError("not an answer for each item")
            except RuntimeError as e:
                got = [str(e)] * len(todo)
                again = todo if str(e).startswith("no answer") or str(e) in [f"HTTP {c}" for c in AGAIN] else []
            except (ValueError, KeyError, TypeError) as e:
                got, again = [f"unlike an answer: {type(e).__name__}"] * len(todo), []
            else:
                status = [g.get("status") if isinstance(g, dict) else None for g in got]
                again = [i for i, c in zip(todo, status, strict=True) if c in AGAIN]
                got = [g if c is None else f"HTTP {c}" for g, c in zip(got, status, strict=True)]
            for i, g in zip(todo, got, strict=True):
                out[i] = g
            todo, wait = again, self.pause * 2**k
            if not todo or k == self.attempts - 1 or time.monotonic() + wait > until:
                break
            time.sleep(wait)
        return out

    def both_of(self, svgs: list[str | None]) -> list[tuple[list[int] | None, str | None, str | None]]:
        """both() for each of svgs, in two requests and those again of what is put off."""
        until = time.monotonic() + self.deadline
        out: list = [(None, None, None)] * len(svgs)
        ids = {}

        def each(places: list[int], answers: list[dict | str], take) -> None:
            for i, a in zip(places, answers, strict=True):
                try:
                    if isinstance(a, str):
                        raise RuntimeError(a)
                    take(i, a)
                except RuntimeError as e:
                    out[i] = (ids.get(i), None, str(e))
                except (ValueError, KeyError, TypeError) as e:
                    out[i] = (ids.get(i), None, f"unlike an answer: {type(e).__name__}")

        def encoded(i: int, a: dict) -> None:
            ids[i] = [int(t) for t in a["token_ids"]]

        def decoded(i: int, a: dict) -> None:
            if not isinstance(a["svg"], str):
                raise TypeError("svg is no text")
            out[i] = (ids[i], a["svg"], None)

        asked = [i for i, svg in enumerate(svgs) if svg is not None]
        if asked:
            each(asked, self.post_all(self.tokenize_url, [{"svg": svgs[i]} for i in asked], until), encoded)
        if ids:
            each([*ids], self.post_all(self.detokenize_url, [{"token_ids": t} for t in ids.values()], until), decoded)
        return out


def round_trip(df: DataFrame, remote: Remote, svg: str = "svg") -> DataFrame:
    """df with token_ids, decoded and error from a remote tokenizer."""
    at = df.columns.index(svg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(remote.in_flight) as pool:
            for batch in batches:
                svgs = batch.column(at).to_pylist()
                if remote.batch > 1:
                    parts = pool.map(remote.both_of, [svgs[k : k + remote.batch] for k in range(0, len(svgs), remote.batch)])
                    rows = [r for part in parts for r in part]
                else:
                    rows = list(pool.map(remote.both, svgs))
                new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "token_ids", "decoded", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, token_ids array<int>, decoded string, error string")
