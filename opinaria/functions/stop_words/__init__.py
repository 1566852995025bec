"""Stop-word lists as package data: those Spark publishes for the languages, one file per language."""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).resolve().parent
LANGUAGES = ("de", "en", "es", "fr", "pt")


def stop_words(language: str) -> list[str]:
    """The list of a language code; no JVM, jar or network is asked."""
    return (FOLDER / f"{language}.txt").read_text(encoding="utf-8").splitlines()
