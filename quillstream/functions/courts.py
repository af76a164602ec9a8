"""Court and prosecution office names brought to their full forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cities that have a district court, the spellings that differ, endings of short names, and short names of their own.
CITIES = "臺北 台北 新北 士林 桃園 新竹 苗栗 臺中 台中 彰化 南投 雲林 嘉義 臺南 台南 高雄 橋頭 屏東 臺東 台東 花蓮 宜蘭 基隆 澎湖 金門 連江".split()
SPELLINGS = {"台北": "臺北", "台中": "臺中", "台南": "臺南", "台東": "臺東"}
ENDINGS = {"地方法院": "地院 地方法院 院".split(), "地方檢察署": "地檢 地檢署 地方檢察署".split()}
SHORT = {
    "高院": "臺灣高等法院",
    "高等法院": "臺灣高等法院",
    "最高院": "最高法院",
    "北院": "臺灣臺北地方法院",
    "北檢": "臺灣臺北地方檢察署",
    "中院": "臺灣臺中地方法院",
    "中檢": "臺灣臺中地方檢察署",
    "南院": "臺灣臺南地方法院",
    "南檢": "臺灣臺南地方檢察署",
    "雄院": "臺灣高雄地方法院",
    "雄檢": "臺灣高雄地方檢察署",
    "士院": "臺灣士林地方法院",
    "士檢": "臺灣士林地方檢察署",
    "橋院": "臺灣橋頭地方法院",
    "橋檢": "臺灣橋頭地方檢察署",
    "新北院": "臺灣新北地方法院",
    "新北檢": "臺灣新北地方檢察署",
    "高檢": "臺灣高等檢察署",
    "高檢署": "臺灣高等檢察署",
    "最高檢": "最高檢察署",
}
ALIASES = {c + e: "臺灣" + SPELLINGS.get(c, c) + full for c in CITIES for full, ends in ENDINGS.items() for e in ends} | SHORT


def normalize_court(c: Column) -> Column:
    """Full names keep their wording but for the first character's spelling; known short names are expanded; others stay; null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    full = t.rlike("^(臺灣|台灣|最高)") & t.rlike("法院|檢察署")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(full, F.replace(t, F.lit("台灣"), F.lit("臺灣"))).otherwise(F.coalesce(F.try_element_at(known, t), t))
