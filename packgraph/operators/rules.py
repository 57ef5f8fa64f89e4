"""Rule classifiers of a building export: first match wins, each with a label, an importance and a confidence.

The words and labels are the contract of the derived tables (fixed values), in the order in which they are tried.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """A label for texts that have one of the words, match the pattern or are one of the names."""

    label: str
    importance: str
    confidence: float
    words: tuple[str, ...] = ()
    pattern: str | None = None
    names: tuple[str, ...] = ()
    decision: str = "keep"

    def matches(self, text: Column) -> Column:
        out = text.rlike(self.pattern) if self.pattern else F.lit(False)
        out = out | text.isin(list(self.names)) if self.names else out
        for w in self.words:
            out = out | F.contains(text, F.lit(w))
        return out


# Elements: decision, category.
EXCLUDED = (
    "sketch", "스케치", "detail", "상세 항목", "insulation lines", "단열재 배팅선", "material", "재료", "재질", "asset", "legend", "범례", "sun path", "태양", "camera", "카메라",
    "project information", "프로젝트 정보", "topography", "toposolid", "contour", "등고선", "base point", "기준점", "internal origin", "내부 원점", "raster", "래스터", "rvt link",
    "rvt 링크", "cad link", "dwg", "curtain grid", "커튼 루프 그리드", "grid 배치", "난간의 난간 경로 확장 선",
)
CORE = (
    "wall", "벽", "floor", "바닥", "door", "문", "window", "창", "ceiling", "천장", "roof", "지붕", "structural framing", "구조 프레임", "structural column", "구조 기둥",
    "structural foundation", "구조 기초", "room", "룸", "space",
)
AUXILIARY = (
    "curtain panel", "커튼월 패널", "wall sweep", "벽 스윕", "generic model", "일반 모델", "furniture", "가구", "railing", "난간", "baluster", "난간동자", "stair", "계단", "gutter",
    "거터", "fascia", "처마돌림", "pipe segment", "배관 세그먼트", "hvac",
)
ELEMENT = (
    Group("reference_or_internal_object", "exclude_candidate", 0.86, EXCLUDED, decision="exclude"),
    Group("core_bim_object", "high", 0.82, CORE),
    Group("auxiliary_bim_object", "medium", 0.72, AUXILIARY, decision="auxiliary"),
    Group("unclassified_bim_object", "medium", 0.5, ("autodesk.revit.db",), decision="auxiliary"),
)
MATERIAL = (
    Group("default_or_hidden", "exclude_candidate", 0.9, ("hidden",), decision="exclude"),
    Group("glass", "high", 0.74, ("glass", "유리")),
    Group("metal", "high", 0.74, ("metal", "steel", "al", "철", "스틸", "알루미늄", "금속", "데크", "루버", "강판", "함석", "srt")),
    Group("concrete_mortar_masonry", "high", 0.74, ("concrete", "mortar", "masonry", "콘크리트", "몰탈", "모르타르", "시멘트", "벽돌")),
    Group("insulation_acoustic", "high", 0.74, ("insulation", "단열", "보온", "그라스울", "우레탄", "흡음", "암면")),
    Group("waterproofing_coating_sealant", "high", 0.74, ("waterproof", "paint", "방수", "도막", "페인트", "에폭시", "코킹", "tpo")),
    Group("board_panel_sheet", "high", 0.74, ("board", "panel", "보드", "패널", "합판", "mdf", "석고")),
    Group("tile_stone_floor_finish", "high", 0.74, ("tile", "stone", "타일", "석재", "대리석", "화강석", "테라조", "강마루")),
    Group("plastic_product", "high", 0.74, ("plastic", "pvc", "abs", "합성수지", "시스템욕실", "가구")),
)
#: Names of materials that stand for none, whatever their class (fixed values).
DEFAULT_MATERIALS = ("hidden", "default wall", "default")
QUANTITY = (
    Group("linear_dimension", "medium", 0.7, ("길이", "length", "폭", "width", "높이", "height", "offset", "간격띄우기")),
    Group("area_perimeter", "high", 0.7, ("면적", "area", "둘레", "perimeter")),
    Group("volume", "high", 0.7, ("체적", "volume")),
    Group("structural_member_length", "high", 0.7, ("절단 길이", "cut length")),
    Group("opening_dimension", "high", 0.7, ("씰", "헤드", "opening", "문틀")),
    Group("room_hvac_load", "medium", 0.7, ("냉방", "난방", "기류", "실외 공기", "supply air")),
    Group("stair_railing_dimension", "medium", 0.7, ("계단", "챌판", "난간")),
    Group("insulation_detail_dimension", "medium", 0.7, ("단열",)),
    Group("view_reference_dimension", "low", 0.7, ("눈 높이", "대상 높이", "무한한 높이")),
)
SHEET = (
    Group("core_drawing_sheet", "high", 0.82, pattern="평면|floor plan|입면|elevation|단면|section"),
    Group("document_admin_sheet", "medium", 0.76, pattern="표지|목록|개요|cover|index|list|summary"),
    Group("supporting_drawing_sheet", "medium", 0.73, pattern="상세|detail|일람|schedule|마감|창호|벽체|패턴|계획|방수|방화|단열|흡음"),
)
SCHEDULE = (
    Group("drawing_schedule", "high", 0.68, pattern="(?s)^(?=.*(?:도면|sheet))(?=.*(?:뷰|view))"),
    Group("drawing_schedule", "medium", 0.68, ("도면", "sheet")),
    Group("finish_schedule", "high", 0.68, ("마감", "finish", "style schedule")),
    Group("floor_quantity_schedule", "high", 0.68, ("floor", "바닥")),
    Group("material_takeoff_schedule", "medium", 0.68, ("material takeoff", "재료")),
)
RELATION = (
    Group("model_semantic_edge", "high", 0.9, names=("element_in_category", "element_has_type", "element_has_material")),
    Group("view_context_edge", "medium", 0.62, names=("view_references_element",)),
    Group("document_layout_edge", "low", 0.9, names=("sheet_has_titleblock", "sheet_contains_viewport")),
    Group("document_layout_edge", "high", 0.9, names=("sheet_contains_view", "viewport_places_view")),
    Group("schedule_table_edge", "high", 0.9, names=("schedule_has_cell",)),
    Group("annotation_context_edge", "high", 0.55, names=("annotation_owned_by_view",)),
    Group("drawing_representation_edge", "high", 0.9, names=(
        "element_has_drawing_representation_index", "element_represented_by_drawing", "element_has_drawing_qa_status", "element_has_semantic_only_drawing_status", "drawing_evidence_on_sheet",
        "drawing_evidence_in_view", "topology_group_has_sample_element", "topology_group_has_member_element", "topology_group_on_sheet", "topology_group_in_view",
    )),
)
#: What a row is called if no group fits: label, importance, confidence, decision.
DEFAULTS = {
    "element": ("unknown_element", "low", 0.35, "unknown"), "material": ("unclassified_material", "medium", 0.42, "keep"), "quantity": ("unclassified_parameter_quantity", "medium", 0.35, "keep"),
    "sheet": ("unclassified_drawing_sheet", "medium", 0.38, "keep"), "schedule": ("unclassified_schedule", "medium", 0.36, "keep"), "relation": ("unclassified_relationship", "medium", 0.35, "keep"),
}
GROUPS: dict[str, Sequence[Group]] = {"element": ELEMENT, "material": MATERIAL, "quantity": QUANTITY, "sheet": SHEET, "schedule": SCHEDULE, "relation": RELATION}


def classified(kind: str, *parts: Column) -> Column:
    """label, importance, confidence and decision of the first group of a kind that fits the parts' joined text."""
    text = F.lower(F.concat_ws(" ", *parts))
    made = lambda label, importance, confidence, decision: F.struct(F.lit(label).alias("label"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"), F.lit(decision).alias("decision"))
    out = made(*DEFAULTS[kind])
    for g in reversed(GROUPS[kind]):
        out = F.when(g.matches(text), made(g.label, g.importance, g.confidence, g.decision)).otherwise(out)
    return out


def material_kind(name: Column, category: Column) -> Column:
    """As classified(), of a material's name without leading marks and its class; a default name decides alone."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "^#+", "")
    g = MATERIAL[0]
    own = F.struct(F.lit(g.label).alias("label"), F.lit(g.importance).alias("importance"), F.lit(g.confidence).alias("confidence"), F.lit(g.decision).alias("decision"))
    return F.when(F.lower(bare).isin(*DEFAULT_MATERIALS), own).otherwise(classified("material", bare, category))


def quantity_kind(record_type: Column, parameter: Column) -> Column:
    """As classified(), but element-material quantities are areas and volumes by their record type."""
    own = F.struct(F.lit("material_area_volume").alias("label"), F.lit("high").alias("importance"), F.lit(0.95).alias("confidence"), F.lit("keep").alias("decision"))
    return F.when(record_type == "element_material_quantity", own).otherwise(classified("quantity", parameter))
