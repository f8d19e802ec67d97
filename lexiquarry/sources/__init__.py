"""Sources and sinks of corpora: book payloads, imports, embedded pages, exports, manifests, state."""
