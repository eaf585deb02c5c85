"""Model clients. Adapters speak HTTP through a ``transport``, which tests replace; nothing here retries, as steps do that."""

from __future__ import annotations

import asyncio
import json
import os
import pickle
import tempfile
import time
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

from ..errors import LLMAPIError, StepError
from ..types import BatchRequest, BatchResult, Citation, LLMResponse, UsageInfo


@runtime_checkable
class LLMClient(Protocol):
    async def complete(self, messages: list[dict], model: str, temperature: float, max_tokens: int, response_format: dict | None = None, tools: list[dict] | None = None, provider_kwargs: dict | None = None) -> LLMResponse: ...


@runtime_checkable
class BatchCapableLLMClient(LLMClient, Protocol):
    async def submit_batch(self, requests: list[BatchRequest], metadata: dict[str, str] | None = None) -> str: ...

    async def poll_batch(self, batch_id: str, poll_interval: float = 60.0, timeout: float = 86400.0) -> BatchResult: ...

    async def cancel_batch(self, batch_id: str) -> None: ...


def is_batch_capable(client: Any) -> bool:
    return all(hasattr(client, n) for n in ("submit_batch", "poll_batch", "cancel_batch")) and bool(getattr(client, "supports_batch", True))


Transport = Callable[[str, str, dict[str, str], bytes | None], tuple[int, dict[str, str], bytes]]


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=600) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()
    except TimeoutError:
        return 408, {}, b"timed out"
    except urllib.error.URLError as e:
        return 408 if isinstance(e.reason, TimeoutError) else 503, {}, str(e.reason).encode()


class _Http:
    """Requests in a thread, failures as LLMAPIError."""

    root, key_variable = "", ""

    def __init__(self, api_key: str | None = None, base_url: str | None = None, transport: Transport = http):
        self.api_key, self.base_url, self.transport = api_key, base_url, transport

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key()}"}

    def key(self) -> str:
        return self.api_key or os.environ.get(self.key_variable, "")

    async def call(self, method: str, path: str, body: Any = None, headers: dict[str, str] | None = None, raw: bool = False) -> Any:
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        url = path if path.startswith("http") else f"{(self.base_url or self.root).rstrip('/')}{path}"
        status, said, got = await asyncio.to_thread(self.transport, method, url, {"Content-Type": "application/json", **self.headers(), **(headers or {})}, data)
        if status >= 300:
            try:
                wait = float(said.get("retry-after", ""))
            except ValueError:
                wait = None
            raise LLMAPIError(f"{type(self).__name__}: status {status}: {got.decode('utf-8', 'replace')[:500]}", status, wait)
        return got.decode() if raw else json.loads(got)

    @staticmethod
    def unique(requests: list[BatchRequest]) -> None:
        ids = [r.custom_id for r in requests]
        if not all(ids) or len(set(ids)) < len(ids):
            raise ValueError("a batch's requests need different, non-empty custom_ids")

    async def poll(self, batch_id: str, look: Callable[[], Any], done: Callable[[dict], bool], interval: float, timeout: float) -> dict:
        end = time.monotonic() + timeout
        while True:
            state = await look()
            if done(state):
                return state
            if time.monotonic() + interval > end:
                raise StepError(f"batch {batch_id} took longer than {timeout:g} s", "batch")
            await asyncio.sleep(interval)


def _split(messages: list[dict]) -> tuple[str, list[dict]]:
    return next((m["content"] for m in reversed(messages) if m["role"] == "system"), ""), [m for m in messages if m["role"] != "system"]


def _distinct(found: list[Citation]) -> list[Citation]:
    return list({c.url: c for c in reversed(found)}.values())[::-1]


class OpenAIClient(_Http):
    """The responses endpoint; chat completions where a base_url names another server, which then has no batches or tools."""

    root, key_variable = "https://api.openai.com/v1", "OPENAI_API_KEY"

    @property
    def supports_batch(self) -> bool:
        return self.base_url is None

    @staticmethod
    def tools(tools: list[dict]) -> list[dict]:
        out = []
        for t in tools:
            own: dict[str, Any] = {"type": "web_search"}
            if t.get("allowed_domains"):
                own["filters"] = {"allowed_domains": t["allowed_domains"]}
            if t.get("user_location"):
                own["user_location"] = {"type": "approximate", **t["user_location"]}
            out.append(own | (t.get("provider_kwargs") or {}))
        return out

    @staticmethod
    def chat(r: Any, model: str) -> LLMResponse:
        u = r.get("usage")
        return LLMResponse(r["choices"][0]["message"].get("content") or "", u and UsageInfo(u["prompt_tokens"], u["completion_tokens"], u["total_tokens"], model))

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None) -> LLMResponse:
        if self.base_url:
            body = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens} | ({"response_format": response_format} if response_format else {}) | (provider_kwargs or {})
            return self.chat(await self.call("POST", "/chat/completions", body), model)
        system, rest = _split(messages)
        body = {"model": model, "input": rest, "temperature": temperature, "max_output_tokens": max_tokens} | ({"instructions": system} if system else {})
        if response_format:
            body["text"] = {"format": {"type": "json_schema", **response_format["json_schema"]} if response_format["type"] == "json_schema" else response_format}
        if tools:
            body["tools"] = self.tools(tools)
        r = await self.call("POST", "/responses", body | (provider_kwargs or {}))
        parts = [p for item in r.get("output", []) if item.get("type") == "message" for p in item.get("content", []) if p.get("type") == "output_text"]
        cited = [Citation(a["url"], a.get("title")) for p in parts for a in p.get("annotations", []) if a.get("type") == "url_citation"]
        u = r.get("usage")
        return LLMResponse("".join(p["text"] for p in parts), u and UsageInfo(u["input_tokens"], u["output_tokens"], u["total_tokens"], model), _distinct(cited))

    async def submit_batch(self, requests, metadata=None) -> str:
        if not self.supports_batch:
            raise StepError("servers behind a base_url have no batch endpoint; set batch=False", "batch")
        self.unique(requests)
        lines = []
        for r in requests:
            body = {"model": r.model, "messages": r.messages, "temperature": r.temperature, "max_tokens": r.max_tokens} | ({"response_format": r.response_format} if r.response_format else {}) | (r.provider_kwargs or {})
            lines.append(json.dumps({"custom_id": r.custom_id, "method": "POST", "url": "/v1/chat/completions", "body": body}))
        edge = uuid.uuid4().hex
        form = f'--{edge}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{edge}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n'.encode()
        file = await self.call("POST", "/files", form + "\n".join(lines).encode() + f"\r\n--{edge}--\r\n".encode(), {"Content-Type": f"multipart/form-data; boundary={edge}"})
        job = await self.call("POST", "/batches", {"input_file_id": file["id"], "endpoint": "/v1/chat/completions", "completion_window": "24h"} | ({"metadata": metadata} if metadata else {}))
        return job["id"]

    async def poll_batch(self, batch_id, poll_interval=60.0, timeout=86400.0) -> BatchResult:
        job = await self.poll(batch_id, lambda: self.call("GET", f"/batches/{batch_id}"), lambda s: s["status"] in ("completed", "failed", "expired", "cancelled"), poll_interval, timeout)
        if job["status"] != "completed" and not job.get("output_file_id"):
            raise StepError(f"batch {batch_id} ended as {job['status']}", "batch")
        out = BatchResult(batch_id)
        for name in filter(None, (job.get("output_file_id"), job.get("error_file_id"))):
            for line in filter(str.strip, (await self.call("GET", f"/files/{name}/content", raw=True)).splitlines()):
                got = json.loads(line)
                answer = got.get("response") or {}
                if answer.get("status_code") == 200:
                    out.responses[got["custom_id"]] = self.chat(answer["body"], answer["body"].get("model", ""))
                else:
                    out.failed_ids.append(got["custom_id"])
                    out.errors[got["custom_id"]] = str((got.get("error") or {}).get("message") or answer.get("body") or "failed")
        return out

    async def cancel_batch(self, batch_id) -> None:
        await self.call("POST", f"/batches/{batch_id}/cancel", {})


class AnthropicClient(_Http):
    """The messages endpoint, the system prompt marked for the prompt cache."""

    root, key_variable = "https://api.anthropic.com/v1", "ANTHROPIC_API_KEY"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key(), "anthropic-version": "2023-06-01"}

    @staticmethod
    def body(messages, model, temperature, max_tokens, response_format, tools, provider_kwargs) -> dict[str, Any]:
        system, rest = _split(messages)
        out: dict[str, Any] = {"model": model, "messages": rest, "max_tokens": max_tokens, "temperature": temperature}
        if system:
            out["system"] = [{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}]
        if tools:
            out["tools"] = []
            for t in tools:
                own = {"type": "web_search_20250305", "name": "web_search"} | {k: t[k] for k in ("allowed_domains", "blocked_domains") if t.get(k)}
                own |= {"user_location": {"type": "approximate", **t["user_location"]}} if t.get("user_location") else {}
                own |= {"max_uses": t["max_searches"]} if t.get("max_searches") is not None else {}
                out["tools"].append(own | (t.get("provider_kwargs") or {}))
        elif response_format and response_format.get("type") == "json_schema":
            out["output_config"] = {"format": {"type": "json_schema", "schema": response_format["json_schema"]["schema"]}}
        return out | (provider_kwargs or {})

    @staticmethod
    def reply(r: dict, model: str) -> LLMResponse:
        parts = [p for p in r.get("content", []) if p.get("type") == "text"]
        cited = [Citation(c["url"], c.get("title"), c.get("cited_text")) for p in parts for c in p.get("citations") or [] if c.get("url")]
        u, usage = r.get("usage"), None
        if u:
            made, read = u.get("cache_creation_input_tokens") or 0, u.get("cache_read_input_tokens") or 0
            usage = UsageInfo(u["input_tokens"], u["output_tokens"], u["input_tokens"] + u["output_tokens"] + made + read, model, made, read)
        return LLMResponse("".join(p["text"] for p in parts), usage, _distinct(cited))

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None) -> LLMResponse:
        return self.reply(await self.call("POST", "/messages", self.body(messages, model, temperature, max_tokens, response_format, tools, provider_kwargs)), model)

    async def submit_batch(self, requests, metadata=None) -> str:
        self.unique(requests)
        body = [{"custom_id": r.custom_id, "params": self.body(r.messages, r.model, r.temperature, r.max_tokens, r.response_format, None, r.provider_kwargs)} for r in requests]
        return (await self.call("POST", "/messages/batches", {"requests": body}))["id"]

    async def poll_batch(self, batch_id, poll_interval=60.0, timeout=86400.0) -> BatchResult:
        job = await self.poll(batch_id, lambda: self.call("GET", f"/messages/batches/{batch_id}"), lambda s: s["processing_status"] == "ended", poll_interval, timeout)
        out = BatchResult(batch_id)
        for line in filter(str.strip, (await self.call("GET", job["results_url"], raw=True)).splitlines()):
            got = json.loads(line)
            if got["result"]["type"] == "succeeded":
                m = got["result"]["message"]
                out.responses[got["custom_id"]] = self.reply(m, m.get("model", ""))
            else:
                out.failed_ids.append(got["custom_id"])
                out.errors[got["custom_id"]] = json.dumps(got["result"].get("error") or got["result"]["type"])
        return out

    async def cancel_batch(self, batch_id) -> None:
        await self.call("POST", f"/messages/batches/{batch_id}/cancel", {})


class GoogleClient(_Http):
    """The generateContent endpoint; it has no batches here."""

    root, key_variable = "https://generativelanguage.googleapis.com/v1beta", "GOOGLE_API_KEY"
    supports_batch = False

    def headers(self) -> dict[str, str]:
        return {"x-goog-api-key": self.key()}

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None) -> LLMResponse:
        system, rest = _split(messages)
        settings: dict[str, Any] = {"temperature": temperature, "maxOutputTokens": max_tokens}
        if response_format:
            settings["responseMimeType"] = "application/json"
            if response_format["type"] == "json_schema" and not tools:
                settings["responseJsonSchema"] = response_format["json_schema"]["schema"]
        body: dict[str, Any] = {"contents": [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in rest], "generationConfig": settings | (provider_kwargs or {})}
        if system:
            body["systemInstruction"] = {"parts": [{"text": system}]}
        if tools:
            body["tools"] = [{"googleSearch": ({"excludeDomains": t["blocked_domains"]} if t.get("blocked_domains") else {}) | (t.get("provider_kwargs") or {})} for t in tools]
        r = await self.call("POST", f"/models/{model}:generateContent", body)
        first = (r.get("candidates") or [{}])[0]
        text = "".join(p.get("text", "") for p in first.get("content", {}).get("parts", []))
        cited = [Citation(c["web"]["uri"], c["web"].get("title")) for c in first.get("groundingMetadata", {}).get("groundingChunks", []) if c.get("web", {}).get("uri")]
        u, usage = r.get("usageMetadata"), None
        if u:
            a, b = u.get("promptTokenCount") or 0, u.get("candidatesTokenCount") or 0
            usage = UsageInfo(a, b, a + b, model)
        return LLMResponse(text, usage, _distinct(cited))


class _Spooled:
    """A batch's requests in a file, as those of a large table don't fit into memory."""

    def __init__(self, file: Any, requests: list[BatchRequest]):
        data = zlib.compress(pickle.dumps(requests), 1)
        self.file, self.at, self.size, self.count = file, file.seek(0, 2), len(data), len(requests)
        file.write(data)

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[BatchRequest]:
        self.file.seek(self.at)
        return iter(pickle.loads(zlib.decompress(self.file.read(self.size))))


class EchoClient:
    """Answers by ``reply(row)``, a function of the row shown in the prompt; the same rows get the same answers on any executor."""

    def __init__(self, reply: Callable[[dict], Any], prompt_tokens: int | None = None, completion_tokens: int | None = None):
        self.reply, self.a, self.b = reply, prompt_tokens, completion_tokens

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None) -> LLMResponse:
        user = next(m["content"] for m in messages if m["role"] == "user")
        row = json.loads(user.split("<row_data>\n", 1)[1].split("\n</row_data>", 1)[0])
        said = self.reply(row)
        if isinstance(said, BaseException):
            raise said
        text = said if isinstance(said, str) else json.dumps(said)
        a, b = self.a if self.a is not None else len(user) // 4, self.b if self.b is not None else len(text) // 4
        return LLMResponse(text, UsageInfo(a, b, a + b, model))

    def __getstate__(self) -> dict[str, Any]:
        """Without the batches, which stay where they were submitted: an executor needs none of them."""
        return {k: v for k, v in self.__dict__.items() if k not in ("held", "spool")}

    async def submit_batch(self, requests, metadata=None) -> str:
        if not hasattr(self, "held"):
            self.held, self.spool = {}, tempfile.TemporaryFile()
        name = f"batch-{len(self.held)}"
        self.held[name] = _Spooled(self.spool, requests)
        return name

    async def poll_batch(self, batch_id, poll_interval=60.0, timeout=86400.0) -> BatchResult:
        out = BatchResult(batch_id)
        for r in self.held[batch_id]:
            try:
                out.responses[r.custom_id] = await self.complete(r.messages, r.model, r.temperature, r.max_tokens)
            except LLMAPIError as e:
                out.failed_ids.append(r.custom_id)
                out.errors[r.custom_id] = str(e)
        return out

    async def cancel_batch(self, batch_id) -> None:
        self.held.pop(batch_id, None)


class ScriptedClient:
    """Gives each row's scripted replies in turn, a text or an exception; rows are told apart by a column's value."""

    def __init__(self, column: str, script: dict[Any, list[Any]]):
        self.column, self.script, self.used = column, script, {}

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None) -> LLMResponse:
        user = next(m["content"] for m in messages if m["role"] == "user")
        key = json.loads(user.split("<row_data>\n", 1)[1].split("\n</row_data>", 1)[0])[self.column]
        i = self.used[key] = self.used.get(key, -1) + 1
        said = self.script[key][min(i, len(self.script[key]) - 1)]
        if isinstance(said, BaseException):
            raise said
        return LLMResponse(said, UsageInfo(11, 3, 14, model))
