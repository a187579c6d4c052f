"""Readers: file trees, ignore rules, manifests, diffs, code-intelligence indexes."""
