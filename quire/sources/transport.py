"""Batches to a model and back, behind a transport that can be any callable (SRC-14, SRC-15, STM-6 to STM-8, STR-11 to STR-13).

A transport takes (prompt) and gives (status, content, finish). ``replay`` is one
that needs no network. Requests of one partition run in sequence; the number of
partitions is the number of requests at a time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str], tuple[int, str, str]]
PERMANENT = {400, 401, 403, 404, 422}
BACKOFF = (2, 5, 10, 20, 40)
_LINE = re.compile(r"\s*(\d+)\s*[.、)]\s*(.+)$")


def request_body(model: str, prompt: str, system: str, messages_protocol: bool = False) -> dict:
    """SRC-14: the body of one request in either protocol."""
    body: dict = {"model": model, "temperature": 0.3, "max_tokens": 8192 if messages_protocol else 16384}
    if messages_protocol:
        return body | {"system": system, "messages": [{"role": "user", "content": prompt}]}
    body["messages"] = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    return body | ({"chat_template_kwargs": {"enable_thinking": False}} if "qwen" in model.lower() else {})


def content_of(answer: dict, messages_protocol: bool = False) -> tuple[str, str]:
    """SRC-14: text and finish reason of an answer in either protocol."""
    if messages_protocol:
        return "".join(p.get("text", "") for p in answer.get("content", [])), answer.get("stop_reason") or ""
    choice = answer["choices"][0]
    return choice["message"]["content"] or "", choice.get("finish_reason") or ""


def http_transport(url: str, key: str, body: Callable[[str], dict], messages_protocol: bool = False, timeout: float = 300.0) -> Transport:
    """A transport over HTTP; one session for each partition that it is pickled to."""

    def send(prompt: str) -> tuple[int, str, str]:
        import requests

        head = {"x-api-key": key, "anthropic-version": "2023-06-01"} if messages_protocol else {"Authorization": f"Bearer {key}"}
        r = requests.post(url, json=body(prompt), headers=head, timeout=max(30.0, timeout))
        return (r.status_code, r.text, "") if r.status_code != 200 else (200, *content_of(r.json(), messages_protocol))

    return send


def probe(base: str, timeout: float = 3.0) -> bool:
    """SRC-15: any HTTP answer of the endpoint or its /v1 counts."""
    import requests

    for url in (base.rstrip("/"), base.rstrip("/") + "/v1"):
        try:
            requests.get(url, timeout=timeout)
            return True
        except requests.RequestException:
            continue
    return False


def replay(prompt: str, sentence: str = "本文提出一种新的方法。") -> tuple[int, str, str]:
    """STR-21 as a transport: each numbered line gets the sentence."""
    return 200, "\n".join(f"{m[1]}. {sentence}" for x in prompt.split("\n") if (m := _LINE.match(x))), "stop"


def numbered(content: str) -> dict[int, str]:
    """STR-11: the last line of a number counts, lines without one are lost."""
    return {int(m[1]): m[2].strip() for x in content.split("\n") if (m := _LINE.match(x))}


def ask(texts: list[str], send: Transport, wait: Callable[[float], None] = time.sleep) -> tuple[dict[int, str], str | None]:
    """STM-6: strict tries with pauses between, then one that takes what there is; (answers, error).

    A permanent status ends at once. Strict: all numbers, and an answer that wasn't cut.
    """
    prompt = "\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1))
    error = None
    for pause in (*BACKOFF, None, None):
        try:
            status, content, finish = send(prompt)
        except Exception as e:  # a transport may raise anything; the batch then counts as failed once more
            status, content, finish = 0, str(e), ""
        if status in PERMANENT:
            return {}, f"HTTP {status}"
        got = numbered(content) if status == 200 else {}
        missing = [i for i in range(1, len(texts) + 1) if i not in got]
        if status == 200 and not missing and finish not in ("length", "max_tokens"):
            return got, None
        error = f"HTTP {status}" if status != 200 else "truncated" if finish in ("length", "max_tokens") else f"missing {missing[:5]}"
        last = got
        if pause is not None:
            wait(pause)
    return last, error


RESULT = "doc_id long, seq int, text string, error string"


def _sent(batches: DataFrame, answer: Callable[[list[str]], tuple[dict[int, str], str | None]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for b in frame.itertuples(index=False):
                got, error = answer([i["text"] for i in b.items])
                out += [(b.doc_id, i["seq"], got.get(k) or None, None if got.get(k) else error) for k, i in enumerate(b.items, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "seq", "text", "error"])

    return batches.mapInPandas(run, RESULT)


def translate(batches: DataFrame, send: Transport, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row for each item of ``batches`` (doc_id, batch_no, items array<struct<seq,text>>); null text where it failed.

    The table is lazy: whoever uses it more than once writes it first (``kept``).
    """
    return _sent(batches, lambda texts: ask(texts, send, wait))


def as_batches(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with batch_no to one row a batch."""
    return paragraphs.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("items"))


def kept(results: DataFrame, path: str) -> DataFrame:
    """Answers written once and read back: a lazy table of requests would send them again for each use."""
    results.write.mode("errorifexists").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def once(texts: list[str], send: Transport) -> tuple[dict[int, str], str | None]:
    """One strict try: all numbers, and an answer that wasn't cut, or nothing."""
    try:
        status, content, finish = send("\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1)))
    except Exception as e:  # a transport may raise anything; the batch then counts as failed
        return {}, str(e)
    got = numbered(content) if status == 200 and finish not in ("length", "max_tokens") else {}
    full = all(i in got for i in range(1, len(texts) + 1))
    return (got, None) if full else ({}, f"HTTP {status}")


def sweep(paragraphs: DataFrame, results: DataFrame, send: Transport, folder: str, rounds: int = 2, budget: float = 420.0, clock: Callable[[], float] = time.monotonic, gate: Callable[[], object] | None = None) -> DataFrame:
    """STM-7: batches with a missing paragraph go once more, in up to two rounds within a time budget.

    Each round sends every such batch once, after ``gate`` (STM-8); it writes its answers under ``folder``, so that
    none is sent twice, and what had come stays where nothing new does. A permanent error ends the sweep.
    """
    end = clock() + budget
    for k in range(rounds):
        failed = results.where("text is null")
        if failed.limit(1).isEmpty() or clock() > end or not failed.where(F.col("error").rlike("^HTTP (400|401|403|404|422)$")).limit(1).isEmpty():
            break
        if gate:
            gate()
        units = paragraphs.join(failed.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").select("doc_id", "batch_no").distinct()
        left = max(0.0, end - clock())
        again = kept(_sent(as_batches(paragraphs.join(units, ["doc_id", "batch_no"], "left_semi")), _within(send, left)), f"{folder}/sweep-{k + 1}")
        new = again.where("text is not null").select("doc_id", "seq", F.col("text").alias("new"))
        joined = results.join(new, ["doc_id", "seq"], "left")
        results = joined.select("doc_id", "seq", F.coalesce("new", "text").alias("text"), F.when(F.coalesce("new", "text").isNull(), F.col("error")).alias("error"))
    return results


def _within(send: Transport, seconds: float) -> Callable[[list[str]], tuple[dict[int, str], str | None]]:
    """One try a batch, none after ``seconds`` in a task."""
    start: list[float] = []

    def run(texts: list[str]) -> tuple[dict[int, str], str | None]:
        start.append(time.monotonic())
        return once(texts, send) if time.monotonic() - start[0] <= seconds else ({}, "out of time")

    return run


def wait_until_serving(send: Transport, most: float = 240.0, pause: float = 5.0, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> bool:
    """STM-8: a short request until one succeeds."""
    end = clock() + most
    while clock() < end:
        if send("1. ok")[0] == 200:
            return True
        wait(pause)
    return False
