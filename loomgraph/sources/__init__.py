"""Readers and writers: file corpora, JSON lines, commit logs, diffs, manifests, snapshots."""
