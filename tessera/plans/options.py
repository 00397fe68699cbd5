"""Options of encoding and decoding, and their names in option maps."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from tessera.functions.container import SHUFFLE_BPP, Hdr, Header

HEURISTICS = ("entropy", "msad", "compression_test", "quick_prune", "adaptive")


@dataclass(frozen=True)
class EncodeOptions:
    tile_rows: int = 64
    level: int = 19
    use_filter: bool = True
    adaptive_analysis: bool = False
    target_color_type: int = 6
    target_bit_depth: int | None = None
    exif: bytes | None = None
    json_metadata: dict = field(default_factory=dict)
    icc_profile: bytes | None = None
    xmp_metadata: str | None = None
    tile_size: tuple[int, int] | None = None
    scan_order: int = 0
    interlace_method: int = 0
    dictionary: bytes | None = None
    sample_format: int = 0
    hdr: Hdr | None = None
    filter_heuristic: str = "entropy"
    use_byte_shuffle: bool = False
    auto_dictionary: bool = False
    palette_algorithm: str = "nearest"
    tonemap_operator: str = "filmic"

    def __post_init__(self):
        if self.filter_heuristic not in HEURISTICS:
            raise ValueError(f"unknown filter heuristic {self.filter_heuristic}")
        if self.use_byte_shuffle and self.interlace_method:
            raise ValueError("byte shuffle can't go with interlacing")
        if self.use_byte_shuffle and Header(1, 1, self.depth, self.sample_format, self.target_color_type).bpp not in SHUFFLE_BPP:
            raise ValueError(f"byte shuffle needs pixels of {SHUFFLE_BPP} bytes")
        if self.interlace_method and (self.target_color_type != 6 or self.sample_format or self.depth != 8):
            raise ValueError("interlacing needs 8-bit RGBA")
        if self.tile_size and (self.interlace_method or self.depth < 8):
            raise ValueError("tiles need at least 8 bits and no interlacing")

    @property
    def depth(self) -> int:
        return self.target_bit_depth or (8, 32, 16)[self.sample_format]

    @classmethod
    def of(cls, options: dict[str, str]) -> EncodeOptions:
        """From a map of strings, as data source options come."""
        kinds = {f.name: f.type for f in fields(cls)}
        read = {"int": int, "int | None": int, "bool": lambda v: v.lower() in ("true", "1", "yes"), "str": str, "str | None": str}
        low = {name.replace("_", ""): name for name in kinds}
        found = {low[k.lower().replace("_", "").replace("-", "")]: v for k, v in options.items() if k.lower().replace("_", "").replace("-", "") in low}
        return cls(**{k: read[kinds[k]](v) for k, v in found.items() if kinds[k] in read})
