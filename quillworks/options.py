"""Extraction options; values become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class ExtractOptions:
    max_input_bytes: int = 50 * MIB
    normalize_whitespace: bool = True
    preserve_paragraphs: bool = True
    paragraph_separator: str = "\n\n"
    markdown_mode: str = "readableText"  # or "raw"
    drop_markdown_code_blocks: bool = True
    remove_duplicate_subtitle_lines: bool = True
    subtitle_cue_separator: str = "\n"
    include_docx_footnotes: bool = True
    include_docx_endnotes: bool = True
    include_docx_headers_and_footers: bool = False
    include_pptx_speaker_notes: bool = True
    max_archive_entry_bytes: int = 64 * MIB
    max_expanded_archive_bytes: int = 128 * MIB
    max_archive_entry_count: int = 2048


@dataclass(frozen=True)
class WebOptions:
    max_input_bytes: int = 5 * MIB
    minimum_readable_characters: int = 40
    max_blocks: int = 10_000
    max_dom_depth: int = 128
    max_dom_elements: int = 50_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "max_input_bytes", max(0, self.max_input_bytes))
        for name in ("minimum_readable_characters", "max_blocks", "max_dom_depth", "max_dom_elements"):
            object.__setattr__(self, name, max(1, getattr(self, name)))
