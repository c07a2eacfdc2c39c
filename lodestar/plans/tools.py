"""The tool surface: checked arguments, cleaned results, errors that never leak what is inside."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..operators import facets, store
from . import retrieval

MAX_QUERY_CHARS, MAX_TOP_K, MAX_IDS, MAX_CHARS = 4096, 100, 100, 20_000


class InvalidRequest(ValueError):
    """The caller's fault; its message may be shown."""


def safe(tool: Callable) -> Callable:
    @wraps(tool)
    def run(*args, **kwargs):
        try:
            return tool(*args, **kwargs)
        except InvalidRequest as e:
            return {"error": {"code": "invalid_request", "message": str(e)}}
        except Exception:  # noqa: BLE001 - nothing internal may reach a caller
            return {"error": {"code": "internal", "message": "internal error"}}

    return run


class Tools:
    """Search, contents and health on one engine; each call of a tool may be counted by a limiter."""

    def __init__(self, engine: retrieval.Engine):
        self.engine, self.stages = engine, retrieval.search_stages(engine)
        self.home_search, self.home_contents, self.home_health = safe(self._search), safe(self._contents), safe(self._health)

    def _search(self, query: str, filters: dict | None = None, top_k: int | None = None, profile: bool = False) -> dict:
        if not isinstance(query, str) or not query.strip():
            raise InvalidRequest("query must not be blank")
        if len(query) > MAX_QUERY_CHARS:
            raise InvalidRequest(f"query has over {MAX_QUERY_CHARS} characters")
        top_k = self.engine.point["k"] if top_k is None else top_k
        if not 0 < top_k <= MAX_TOP_K:
            raise InvalidRequest(f"top_k must be 1 to {MAX_TOP_K}")
        try:
            facets.translate_filters(filters)
        except ValueError as e:
            raise InvalidRequest(str(e)) from e
        out = retrieval.run_search(self.stages, query, filters, top_k, profile)
        if "error" in out:
            out["error"] = {"code": "internal", "message": "internal error"}
        return out

    def _contents(self, ids: list[str], max_chars_per_doc: int = 8000) -> dict:
        if not ids or not isinstance(ids, list | tuple):
            raise InvalidRequest("ids must be a list of at least one")
        if len(ids) > MAX_IDS:
            raise InvalidRequest(f"over {MAX_IDS} ids")
        if not 0 < max_chars_per_doc <= MAX_CHARS:
            raise InvalidRequest(f"max_chars_per_doc must be 1 to {MAX_CHARS}")
        rows = store.contents(self.engine.store, list(ids), max_chars_per_doc).collect()  # at most a page
        items = [{"id": r["id"], "error": r["error"]} if r["error"] else {"id": r["id"], "url": r["url"], "title": r["title"], "text": r["text"], "provenance": "corpus", "untrusted": True} for r in rows]
        return {"items": items, **store.paging(len(ids))}

    def _health(self) -> dict:
        parts = {"index": self.engine.index, "store": self.engine.store, "embedder": self.engine.embedder, "reranker": self.engine.score}
        return {"ok": all(v is not None for v in parts.values()), "parts": {k: v is not None for k, v in parts.items()}, "operating_point": dict(self.engine.point)}
