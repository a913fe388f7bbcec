"""Sources and sinks."""

from .files import append_jsonl, documents_from_products, read_catalog, read_index, read_jsonl, read_jsonl_tail, read_products, upserted, write_index, zipped_json

__all__ = ["append_jsonl", "documents_from_products", "read_catalog", "read_index", "read_jsonl", "read_jsonl_tail", "read_products", "upserted", "write_index", "zipped_json"]
