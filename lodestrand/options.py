"""What a run checks and repairs, and the XML files that hold it."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .rules import RuleSet, default_rules, load_rules, save_rules

SECTION = "ValidateFastaFileOptions"
FIX_SECTION = "ValidateFastaFixedFASTAFileOptions"


@dataclass(frozen=True)
class Options:
    # checks
    check_duplicate_names: bool = True
    check_duplicate_sequences: bool = True
    warn_blank_lines_between: bool = False
    warn_line_starts_with_space: bool = True
    allow_asterisk: bool = False
    allow_dash: bool = False
    allow_all_symbols_in_names: bool = False
    max_findings: int = 5
    min_name_length: int = 3
    max_name_length: int = 60
    max_residues_per_line: int = 120
    header_start: str = ">"
    strict_eof: bool = False
    #: A header forgets the blank lines before it; off, as the checks have always been.
    reset_blank_on_header: bool = False
    # repair
    fix: bool = False
    rename_duplicates: bool = False
    keep_same_name: bool = False
    consolidate: bool = False
    ignore_il: bool = False
    truncate_long_names: bool = True
    wrap_residues: bool = True
    remove_invalid_residues: bool = False
    split_known_accessions: bool = True
    split_multiple_refs: bool = False
    invalid_name_chars: str = ""
    long_name_split_chars: str = "|"
    first_ref_separators: str = ":|"
    subsequent_ref_separators: str = ":|;"
    # outputs
    add_missing_line_feed: bool = False
    normalize_line_ends: bool = False
    stats_file: bool = False
    save_hashes: bool = False
    save_basic_hashes: bool = False
    rules: RuleSet | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        clamp = lambda name, value: object.__setattr__(self, name, value)
        clamp("max_findings", max(1, self.max_findings))
        clamp("min_name_length", max(1, self.min_name_length))
        clamp("max_name_length", max(8, self.max_name_length))
        clamp("max_residues_per_line", 40 if 0 <= self.max_residues_per_line < 40 else self.max_residues_per_line)
        for name in ("invalid_name_chars", "long_name_split_chars", "first_ref_separators", "subsequent_ref_separators"):
            clamp(name, getattr(self, name).replace(" ", ""))
        if not self.long_name_split_chars:
            clamp("long_name_split_chars", "|")

    @property
    def rule_set(self) -> RuleSet:
        return self.rules or default_rules(self.allow_asterisk, self.allow_dash, self.allow_all_symbols_in_names)

    @property
    def needs_residues(self) -> bool:
        """Residues are put together only where something asks for them."""
        return (self.fix or self.check_duplicate_sequences or self.save_basic_hashes) and (self.check_duplicate_sequences or self.wrap_residues)

    @property
    def hash_ignores_il(self) -> bool:
        return self.ignore_il and self.fix and (self.consolidate or self.keep_same_name)

    def for_hash_file(self) -> Options:
        """The options that hold when a table of hashes decides what stays."""
        return replace(self, fix=True, consolidate=False, rename_duplicates=False, save_basic_hashes=False, check_duplicate_sequences=False, check_duplicate_names=False)


# The names that the XML files give to the options. Fixed values.
XML_KEYS = {
    SECTION: {
        "MaximumFileErrorsToTrack": "max_findings",
        "MinimumProteinNameLength": "min_name_length",
        "MaximumProteinNameLength": "max_name_length",
        "MaximumResiduesPerLine": "max_residues_per_line",
        "WarnBlankLinesBetweenProteins": "warn_blank_lines_between",
        "WarnLineStartsWithSpace": "warn_line_starts_with_space",
        "CheckForDuplicateProteinNames": "check_duplicate_names",
        "CheckForDuplicateProteinSequences": "check_duplicate_sequences",
        "SaveProteinSequenceHashInfoFiles": "save_hashes",
        "SaveBasicProteinHashInfoFile": "save_basic_hashes",
        "AllowAsteriskInResidues": "allow_asterisk",
        "AllowDashInResidues": "allow_dash",
        "AddMissingLinefeedAtEOF": "add_missing_line_feed",
        "NormalizeFileLineEndCharacters": "normalize_line_ends",
        "OutputToStatsFile": "stats_file",
    },
    FIX_SECTION: {
        "GenerateFixedFASTAFile": "fix",
        "TruncateLongProteinNames": "truncate_long_names",
        "RenameDuplicateNameProteins": "rename_duplicates",
        "KeepDuplicateNamedProteins": "keep_same_name",
        "ConsolidateDuplicateProteinSeqs": "consolidate",
        "ConsolidateDupsIgnoreILDiff": "ignore_il",
        "WrapLongResidueLines": "wrap_residues",
        "RemoveInvalidResidues": "remove_invalid_residues",
        "SplitOutMultipleRefsForKnownAccession": "split_known_accessions",
        "SplitOutMultipleRefsInProteinName": "split_multiple_refs",
        "LongProteinNameSplitChars": "long_name_split_chars",
        "ProteinNameInvalidCharsToRemove": "invalid_name_chars",
        "ProteinNameFirstRefSepChars": "first_ref_separators",
        "ProteinNameSubsequentRefSepChars": "subsequent_ref_separators",
    },
}


def parse_xml(text: str) -> dict[str, dict[str, str]]:
    """{section: {key: value}}; attribute values may hold a raw ``<`` or ``&`` (regular expressions do)."""
    escaped = re.sub(r'"([^"]*)"', lambda m: '"' + re.sub(r"&(?!\w+;|#)", "&amp;", m[1]).replace("<", "&lt;") + '"', text.lstrip("﻿"))
    root = ET.fromstring(escaped)
    return {s.get("name"): {i.get("key"): i.get("value", "") for i in s.iter("item")} for s in root.iter("section")}


def load_options(path: str | Path, base: Options | None = None) -> Options:
    """``base`` with the settings of an XML file, the file's rules replace the default ones; one that is not there is looked for by its name in the program's folder."""
    path = Path(path) if Path(path).exists() else Path(__file__).parent / Path(path).name
    sections = parse_xml(path.read_text(encoding="utf-8", errors="replace"))
    if SECTION not in sections:
        raise ValueError(f"{path} has no section {SECTION}")
    base, values = base or Options(), {}
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Options)}
    for section, keys in XML_KEYS.items():
        for key, name in keys.items():
            if (value := sections.get(section, {}).get(key)) is not None:
                values[name] = value.strip().lower() == "true" if kinds[name] is bool else int(value) if kinds[name] is int else value
    return replace(base, **values, rules=load_rules(sections))


def save_options(options: Options, path: str | Path) -> None:
    root = ET.Element("sections")
    for section, keys in XML_KEYS.items():
        node = ET.SubElement(root, "section", name=section)
        for key, name in keys.items():
            value = getattr(options, name)
            ET.SubElement(node, "item", key=key, value=str(value))
    save_rules(options.rule_set, root)
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
