"""Declared schemas. Files with other fields are reported, never guessed at."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

_S, _L, _T = StringType(), LongType(), TimestampType()


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


AUTHOR = _struct(name=_S, account_created_at=_T, karma=_L, flair=_S, contributions=_L)
COMMENT = _struct(id=_S, parent_id=_S, author=AUTHOR, body=_S, created_at=_T, score=_L, url=_S, status=_S, verified_at=_T, edited=_S)
THREAD = _struct(
    id=_S, source=_S, community=_S, category=_S, title=_S, body=_S, author=AUTHOR, created_at=_T, score=_L, num_comments=_L, url=_S, collected_at=_T, read_from=_S, checked_live_at=_T,
    comments=ArrayType(COMMENT),
    whole_thread=_struct(
        slimmed_at=_T, extraction=_S, post_names=ArrayType(_S), post_need_words=ArrayType(_S), post_list_words=ArrayType(_S), post_words=ArrayType(_S), comment_names=MapType(_S, ArrayType(_S)),
        copies=ArrayType(ArrayType(_S)), first_seen=MapType(_S, _T), quoted_elsewhere=ArrayType(_S), dropped=MapType(_S, _S),
    ),
)
EXTRACTION = _struct(
    thread_id=_S, instructions_version=_S, extracted_at=_T, extractor=_S,
    mentions=ArrayType(_struct(comment_id=_S, product=_S, category=_S, stance=_S, quote=_S, refers_to=_S, product_type=_S, evidence=_S, evidence_tags=ArrayType(_S))),
    notes=ArrayType(_struct(comment_id=_S, about=_S, stance=_S, quote=_S)),
    agreements=ArrayType(_struct(comment_id=_S, quote=_S)),
    care=ArrayType(_struct(comment_id=_S, about=_S, is_kind=BooleanType(), tip=_S, quote=_S)),
)
VOICES = _struct(thread_id=_S, comment_id=_S, voice=_S, tags=_S, note=_S, agrees=_S)
LABELS = _struct(comment_id=_S, product=_S, category=_S, stance=_S, evidence=_S, tags=_S, note=_S, kind=_S)
PRICES = _struct(product=_S, category=_S, price=DoubleType(), currency=_S, shop=_S, url=_S, checked_on=_S, available=BooleanType(), product_type=_S, second_hand=BooleanType(), not_in_uk=BooleanType(), also_called=ArrayType(_S), note=_S, sources=ArrayType(_S))
