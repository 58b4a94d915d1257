"""Category-code lookups of the original card-transaction study.

The original maps merchant category codes to a detail label and to a
large group with dictionary literals; a repeated code keeps its last
label.  ``card_category_map`` turns them into the (code, detail,
large_group) table the rollup and segment-mix operators take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The original's lookup tables, in their order (pairs, so
# repeated codes are kept as written; the last one wins).
MCC_DETAIL = [
    (5411, "슈퍼마켓"), (5499, "식료품점"), (5541, "주유소"), (5812, "음식점"), (5912, "약국"),
    (4829, "금융서비스(송금)"), (4784, "교통(유료도로)"), (5300, "대형마트"), (4121, "택시/차량"),
    (7538, "자동차수리"), (5814, "패스트푸드"), (5311, "백화점"), (4900, "공과금(유틸리티)"),
    (5310, "할인마트"), (5813, "주류"), (5942, "서점"), (4814, "통신"), (5211, "건축자재"),
    (7832, "영화관"), (5921, "편의점(주류)"), (5651, "의류"), (5661, "신발"), (5691, "의류(일반)"),
    (5712, "가구"), (5732, "전자제품"), (5999, "기타소매"), (5261, "원예"), (5251, "철물점"),
    (4111, "대중교통"), (7011, "호텔"), (5441, "사탕/과자"), (5462, "베이커리"), (5411, "슈퍼마켓"),
    (5945, "완구/취미"), (5065, "전자부품"), (5047, "의료용품"), (7299, "기타서비스"), (5122, "의약품"),
    (5621, "여성의류"), (5631, "여성액세서리"), (7523, "주차"), (5411, "슈퍼마켓"),
]
MCC_GROUP = [
    (5411, "식품/식료품"), (5499, "식품/식료품"), (5300, "식품/식료품"), (5310, "식품/식료품"),
    (5814, "식품/식료품"), (5812, "음식점"), (5813, "음식점"), (5441, "음식점"), (5462, "음식점"),
    (5541, "교통/자동차"), (4121, "교통/자동차"), (7538, "교통/자동차"), (4111, "교통/자동차"),
    (4784, "교통/자동차"), (5912, "의료/약국"), (5047, "의료/약국"), (5122, "의료/약국"),
    (4829, "금융서비스"), (4900, "공과금"), (4814, "통신"), (5311, "쇼핑"), (5651, "쇼핑"),
    (5661, "쇼핑"), (5691, "쇼핑"), (5732, "쇼핑"), (5712, "쇼핑"), (5999, "쇼핑"), (5211, "쇼핑"),
    (5942, "엔터테인먼트"), (7832, "엔터테인먼트"), (5945, "엔터테인먼트"), (7011, "여행/숙박"),
    (5921, "편의점"), (5813, "주류"),
]
MCC_EXPORT = [
    (5411, "슈퍼마켓"), (5499, "식료품점"), (5541, "주유소"), (5812, "음식점"), (5912, "약국"),
    (4829, "금융서비스"), (4784, "교통(유료도로)"), (5300, "대형마트"), (4121, "택시/차량"),
    (7538, "자동차수리"), (5814, "패스트푸드"), (5311, "백화점"), (4900, "공과금"), (5310, "할인마트"),
    (5813, "주류"), (5942, "서점"), (4814, "통신"), (5211, "건축자재"), (7832, "영화관"), (5921, "편의점"),
]
DEFAULT_LABEL = "기타"


def _last_wins(pairs) -> dict:
    out: dict = {}
    for code, label in pairs:
        out[str(code)] = label
    return out


def card_category_map(spark: SparkSession, detail=MCC_DETAIL, group=MCC_GROUP) -> DataFrame:
    """(code, detail, large_group) for card category codes; codes are text
    so they join with the raw ``mcc`` column.  Unmapped sides are NULL (the
    operators apply their default label)."""
    d, g = _last_wins(detail), _last_wins(group)
    rows = [(code, d.get(code), g.get(code)) for code in sorted(set(d) | set(g))]
    return spark.createDataFrame(rows, "code string, detail string, large_group string")
