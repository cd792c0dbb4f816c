"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from schemawake.functions import declarations as D
from schemawake.functions import ids as I
from schemawake.functions import naming as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "id_"),
    [
        ("boolFalse = Bool", 0xBC799737),
        ("boolTrue = Bool", 0x997275B5),
        ("vector t:Type # [ t ] = Vector t", 0x1CB5C415),
        ("invokeAfterMsg {X:Type} msg_id:long query:!X = X", 0xCB9F372D),
    ],
)
def test_checksum(spark, text, id_):
    assert one(spark, D.checksum_id(F.lit(text))) == id_


def test_ids(spark):
    assert one(spark, I.signed_text_to_hex(F.lit("-470607587"))) == "e3f3191d"
    assert one(spark, I.signed_text_to_hex(F.lit("255"))) == "ff"
    assert one(spark, I.signed_text_to_hex(F.lit("abc"))) == "0"
    assert one(spark, I.hex_to_signed(F.lit("e41cd11d"))) == -467873507
    assert one(spark, I.hex_to_unsigned(F.lit("e41cd11d"))) == 3827093789
    assert one(spark, I.bit_of_mask(F.lit(8))) == 3
    assert one(spark, I.bit_of_mask(F.lit(6))) is None


@pytest.mark.parametrize(
    ("name", "hint", "expected"),
    [
        ("TL_messages_sendMessage", "", ("messages.sendMessage", 0)),
        ("TL_message_layer117", "", ("message", 117)),
        ("TL_user_layer104_old2", "", ("user", 1)),
        ("TL_channelFull_old", "", ("channelFull", 1)),
        ("TL_photo_123", "", ("photo", 123)),
        ("storiesGetAll", "TL_stories", ("stories.getAll", 0)),
        ("TLObject", "", ("", 0)),
    ],
)
def test_class_names(spark, name, hint, expected):
    assert tuple(one(spark, N.class_name(F.lit(name), F.lit(hint)))) == expected


@pytest.mark.parametrize(("name", "fixed"), [("isAdmin", "is_admin"), ("isForum", "forum"), ("webPage", "page"), ("hash2", "hash"), ("viaInvite", "via_request"), ("stickerItem", "sticker"), ("doc", "id")])
def test_param_names(spark, name, fixed):
    assert one(spark, N.param_name(F.lit(name))) == fixed


def test_versions_and_markup(spark):
    assert one(spark, D.version_code(F.lit("1.8.46"))) == 10846
    assert one(spark, D.version_code(F.lit("1.12.3"))) == 11203
    assert one(spark, N.markup_to_html(F.lit("**a** & *b* `c`"))) == "<b>a</b> &amp; <i>b</i> <code>c</code>"


def test_atoms(spark):
    assert one(spark, D.atoms(F.lit("Vector<Vector<!X>> foo"))) == ["Vector", "Vector", "X", "foo"]
