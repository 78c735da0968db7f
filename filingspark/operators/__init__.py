"""Operators: document parser, fact extraction, wide transform, comparison, taxonomy."""
