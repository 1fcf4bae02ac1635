"""Column functions: no state, no UDFs, usable in any select or filter."""

from lineflow.functions.draws import draw, draw_below, mixture
from lineflow.functions.folding import (
    case_table,
    fold_case,
    ordinal_ci_between,
    ordinal_ci_compare,
    ordinal_ci_equal,
    ordinal_ci_key,
    utf16_length,
)
from lineflow.functions.parsing import (
    dot_position,
    has_text,
    line_bytes,
    line_number,
    line_text,
    reject_reason,
    render_line,
    strip_all_cr,
    strip_cr,
)
from lineflow.functions.paths import part_number, part_path
from lineflow.functions.sizes import parse_size, size_in_bytes

__all__ = [
    "case_table",
    "dot_position",
    "draw",
    "draw_below",
    "fold_case",
    "has_text",
    "line_bytes",
    "line_number",
    "line_text",
    "mixture",
    "ordinal_ci_between",
    "ordinal_ci_compare",
    "ordinal_ci_equal",
    "ordinal_ci_key",
    "parse_size",
    "part_number",
    "part_path",
    "reject_reason",
    "render_line",
    "size_in_bytes",
    "strip_all_cr",
    "strip_cr",
    "utf16_length",
]
