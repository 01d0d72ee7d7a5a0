"""Relations of the document model, and the settings that change results."""

from __future__ import annotations

from dataclasses import dataclass, replace

RUBY = "array<struct<start:int,end:int,text:string,score:double,box:array<double>,alignment:string>>"
CHARS = "array<struct<text:string,box:array<double>,offset:int>>"
CELL = "struct<row:int,column:int,rowSpan:int,colSpan:int,text:string,box:array<double>>"

TASKS = (
    "task_id string, batch_id string, batch_index int, path string, file_name string, status string, result_type string, page_range string, rotation int, "
    "revision int, exported_revision int, text_edited boolean, source_size bigint, source_mtime_ns bigint"
)
PAGES = "task_id string, page_index int, text string, raw_text string, schema_version int, width double, height double, source string, ruby_enabled boolean"
BLOCKS = (
    "task_id string, page_index int, block_ord int, text string, score double, box array<double>, polygon array<array<double>>, direction string, font_size double, "
    f"source string, role string, ruby {RUBY}"
)
TABLES = "task_id string, page_index int, end_page_index int, table_index int, source_table_count int, score double, box array<double>"
CELLS = "task_id string, page_index int, table_index int, row_ord int, cell_ord int, row int, column int, row_span int, col_span int, text string, box array<double>"
EVENTS = "generation long, task_id string, page_index int, text string, n_blocks int, n_tables int, arrival long"
EDITS = EVENTS + ", kind string, edited_pages int"  # pages and edits as two kinds of events


@dataclass(frozen=True)
class TextSettings:
    pdf_source: str = "auto"
    ruby_enabled: bool = False
    ruby_format: str = "parentheses"
    text_mode: str = "smart"
    cross_page: bool = True

    def normalised(self) -> "TextSettings":
        """Every value outside its domain becomes the default."""
        return replace(
            self,
            pdf_source="ocr" if self.pdf_source == "ocr" else "auto",
            ruby_enabled=self.ruby_enabled is True,
            ruby_format=self.ruby_format if self.ruby_format in ("ignore", "ruby") else "parentheses",
            text_mode=self.text_mode if self.text_mode in ("original", "continuous") else "smart",
            cross_page=self.cross_page is not False,
        )


@dataclass(frozen=True)
class ExportOptions:
    grouping: str = "separate"
    collision: str = "rename"
    prefix: str = ""
    suffix: str = ""
    name: str = ""
    date: str | None = None  # for {date}; today by default

    def normalised(self) -> "ExportOptions":
        """Rules outside their domain become the default; prefix, suffix and name are cut to 100 characters."""
        return replace(
            self,
            grouping="combined" if self.grouping == "combined" else "separate",
            collision=self.collision if self.collision in ("skip", "overwrite") else "rename",
            prefix=self.prefix[:100], suffix=self.suffix[:100], name=self.name[:100],
        )
