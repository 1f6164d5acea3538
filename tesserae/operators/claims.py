"""Claims that a text may make only if its keywords support them, as presets for tesserae.operators.textrules.Rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tesserae.operators.textrules import Claim

#: The words and patterns of the claims, and the keywords that support them.
TIME_WORDS = ("周末", "假期", "下班后", "放学后", "晚上", "下午", "白天", "工作日", "周内")
DURATION = "半小时|[0-9０-９]+\\.?[0-9０-９]*\\s*(分钟|小时)|[一二两三四五六七八九十]+个?多?小时|[一二两三四五六七八九十]+十?多?分钟"
USES = (("钥匙扣", "钥匙扣"), ("挂包|包上|挂在包", "挂包|包上|挂在包|包"), ("小袋子|收纳袋|送袋子|袋子", "小袋子|收纳袋|送袋子|袋子|包装"), ("免费", "免费"))
PACKAGE_WORDS = ("全天", "不限时", "不限量", "不限板", "套餐", "划算", "大图")
PACKAGE_KEYWORDS = "全天|不限时|不限量|不限板|套餐|大图|大作品|时间充裕|时间长|慢慢拼"
QUALITY_PROJECT = "拼豆"
QUALITY_WORDS = (
    "无毛刺", "没有毛刺", "无混豆", "没有混豆", "不混豆", "无高低豆", "没有高低豆", "豆子圆润", "豆子平整", "质量好", "质量不错", "品质好", "品质不错", "质感厚实", "不易碎", "不卡豆", "垫板", "清洁刷",
    "夹取顺滑", "镊子顺手", "受热均匀", "不过度融化", "不溢边", "无孔", "熨烫平整", "烫得快", "烫得好", "低温熨烫", "毛巾烫", "压豆", "控温", "不会翻车", "不翻车", "补救", "换板",
)
QUALITY_KEYWORDS = "质量|质感|毛刺|混豆|高低豆|圆润|平整|镊子|垫板|清洁刷|卡豆|夹取|熨烫|烫|压豆|控温|翻车|补救|换板|受热|溢边|无孔|工具|豆子"
PLACE_WORDS = ("空调", "安静", "座位很多", "座位多", "空间充足", "空间大", "宽敞", "灯光", "明亮", "坐满", "人气旺", "需要等位", "排队", "人多", "有序", "不打扰")
PLACE_KEYWORDS = "空调|安静|座位|空间|位置|环境|人多|等位|排队|坐满|宽敞|灯光|明亮|有序|不打扰"
PRINT, PRINT_KEYWORDS = "打印图纸|打图纸|图纸打印", "打印图纸|打图纸|图纸打印|图纸"

#: The claims by the reason that they give, in the order in which they are checked.
PRESETS: Mapping[str, Sequence[Claim]] = {
    "unprovided_time": (Claim(words=TIME_WORDS),),
    "unprovided_duration": (Claim(pattern=DURATION),),
    "unsupported_use": tuple(Claim(pattern=said, gate=gate) for said, gate in USES),
    "unprovided_package": (Claim(words=PACKAGE_WORDS, gate=PACKAGE_KEYWORDS),),
    "unprovided_quality": (Claim(words=QUALITY_WORDS, gate=QUALITY_KEYWORDS, projects=(QUALITY_PROJECT,)),),
    "unprovided_environment": (Claim(words=PLACE_WORDS, gate=PLACE_KEYWORDS),),
    "unprovided_print": (Claim(pattern=PRINT, gate=PRINT_KEYWORDS),),
}
