"""Word lists and patterns that decide results. Fixed values throughout; callers may pass their own."""

from __future__ import annotations

# Moods in the order of detection, each with its words.
MOOD_ORDER = ("放弃", "愤怒", "悲伤", "焦虑", "困惑", "意外", "开心")
MOODS = {
    "愤怒": ["气死", "恼火", "凭什么", "不公平", "过分", "太气人了", "火大", "无语", "受不了", "真恶心", "怎么这样", "太糟糕了", "烦死了", "气死我了", "烦死", "气炸", "真烦", "真火大", "要气死", "被气到", "好生气", "受够了", "崩溃了", "无语了", "恶心", "恼人", "操蛋", "扯淡", "折磨", "劝退", "坑爹", "垃圾", "烂", "废了", "有毒"]
    + ["angry", "pissed off", "outrageous", "unfair", "ridiculous", "unacceptable"],
    "悲伤": ["难过", "伤心", "好累", "不想动", "心累", "崩溃", "失望", "没劲", "没意思", "提不起劲", "好难过", "废物", "没用", "搞砸了", "又错了", "做不好", "失败", "不行了", "完蛋了", "好难", "太难了", "做不动", "撑不住", "痛苦"]
    + ["sad", "depressed", "heartbroken", "disappointed", "exhausted", "drained", "terrible", "failure", "useless", "messed up", "can't do this"],
    "焦虑": ["焦虑", "紧张", "压力好大", "害怕", "不安", "担心", "怎么办", "万一", "会不会", "好怕"] + ["anxious", "nervous", "stressed", "worried", "afraid", "scared"],
    "放弃": ["不管了", "随便", "放弃", "累了", "不想做了", "就这样吧", "不做了", "算了算了", "不纠结了", "爱咋咋地", "无所谓", "能用就行"] + ["whatever", "give up", "i don't care", "fine, do what you want", "i quit"],
    "开心": ["开心", "太好了", "太棒了", "满意", "有意思", "值得", "兴奋", "好棒", "哈哈", "nice", "真不错", "有成就感", "爽", "喜欢", "终于", "很好", "不错", "舒服", "完美", "真香", "赞", "厉害", "搞定", "跑通了", "稳了", "通了", "漂亮", "优秀", "强大", "惊喜", "感动", "成就感", "自豪", "高兴", "愉快", "轻松", "好使", "管用", "真快", "丝滑", "起飞", "牛批", "无敌", "爱了", "推荐", "好用", "简洁", "清晰", "优雅"]
    + ["happy", "great", "excited", "awesome", "love it", "worth it", "amazing"],
    "困惑": ["不懂", "不明白", "怎么回事", "啥意思", "搞不懂", "奇怪", "不对劲", "不太对", "有点奇怪", "没搞明白"] + ["confused", "don't understand", "what's going on", "doesn't make sense"],
    "意外": ["没想到", "竟然", "不是吧", "真的假的", "天哪", "怎么回事这样", "原来是"] + ["wow", "unexpected", "surprised", "really", "no way", "oh my"],
}
HAPPY = "开心"
NEGATORS = ["不", "没", "不是", "不太", "并不", "并不太", "not ", "don't ", "doesn't ", "isn't ", "aren't ", "never ", "no ", "hardly "]
IMPACTS = ["他让", "她让", "他们让", "害得", "he makes", "she makes", "they make"]
OTHERS = ["他", "她", "他们", "那个人", "别人", "he ", "she ", "they ", "that person", "someone"]

# Signals of drift and the directions of a choice.
DRIFT = {
    "frugal": ["免费", "不花钱", "自己搞", "本地", "省钱", "性价比", "开源"],
    "spend": ["花钱", "省事", "买", "付费", "订阅", "不值", "效率优先"],
    "give_up": ["不管了", "放弃", "不搞了", "不做了", "算了不弄", "不想管", "懒得弄", "不折腾了"],
    "compromise": ["能用就行", "不纠结", "就那样", "将就", "凑合", "差不多得了", "无所谓了", "先这样吧"],
    "annoyed": ["随便", "算了", "就这样", "烦死了", "受不了", "太麻烦", "真无语", "够了"],
}
DIRECTIONS = {
    "frugal": ["免费", "不花钱", "省钱", "性价比", "开源", "自己搞", "本地", "free", "open source", "self-host"],
    "spend": ["花钱", "付费", "买", "效率优先", "buy", "pay", "subscription"],
    "drift": ["不管了", "随便", "放弃", "不纠结", "whatever", "give up", "fine"],
}

# Memory types by first match, in this order.
MEMORY_TYPES = {
    "procedural": "(怎么|如何|步骤|教程|部署|配置|安装|运行|启动|操作|流程|方法)",
    "emotional": "(开心|难过|生气|焦虑|喜欢|讨厌|高兴|伤心|烦|累|失望|兴奋|紧张|害怕|感动|委屈)",
    "episodic": "(昨天|今天|上周|下个月|买了|去了|做了|见到|发生|期间|当时|月份|年度|时候|那[天次])",
}

# What makes a message worth keeping.
INFO_WORDS = "建议|需要|注意|因为|方案|步骤|第一种|第二种|推荐|区别|对比|优点是|缺点是"
TRIVIAL = "^(好的|明白了|没问题|请稍等|我来看看|是的|对的|你说得对|当然可以|不用担心|不客气|谢谢|可以|好|嗯|OK|ok|嗯嗯|好的呢|没问题呢|知道了|收到)"
KEEP_ARCHIVED = r"\d{3,}|建议|方案|步骤|注意|因为|所以"

# Patterns of relations in free text; one group is the object, two are subject and object.
RELATIONS = (
    (r"(?:决定用|最终用|换用|改用|选了|选择用|采用了|用了|用上了)\s*([一-鿿\w]+)", "使用"),
    (r"(?:放弃|不用|砍掉|去掉|移除|弃用|拒了|不用了)\s*了?\s*([一-鿿\w]+)", "放弃"),
    (r"([一-鿿\w]{2,8})\s*(?:比|优于|好过|胜过|强于|不如)\s*([一-鿿\w]+)", "对比"),
    (r"(?:把|将)\s*([一-鿿\w]+)\s*(?:换成|替换为|改成|迁移到|切到|替代为)\s*([一-鿿\w]+)", "替换为"),
    (r"用了?\s*([一-鿿\w]+)\s*替代\s*([一-鿿\w]+)", "替代"),
    (r"从\s*([一-鿿\w]+)\s*迁到\s*([一-鿿\w]+)", "迁移"),
    (r"(?:装了|安装了|部署了|搭建了)\s*([一-鿿\w]+)", "安装"),
    (r"(?:依赖|基于|构建在)\s*([一-鿿\w]+)上?", "依赖"),
    (r"(?:喜欢|偏好|倾向|偏爱)\s*([一-鿿\w]+)", "偏好"),
    (r"(?:讨厌|不喜欢|反感|烦)\s*([一-鿿\w]+)", "反感"),
)
LEADING_PARTICLE = "^[了着过的和在或与已]"

# Words of events' moods and their valence.
EVENT_MOOD = {"purchase": ("happy", 1.0), "error": ("anger", -1.0), "view": ("confused", -0.3), "click": ("surprised", 0.3), "signup": ("anxious", -0.7)}

# Patterns of choices (first group), of actions, and words of giving up; words that are no choice.
CHOICES = (
    r"(?:我?选|就|还是|决定|定了|要)(?:择|用|搞|弄)?\s*[「『\"]?(.{1,30}?)[」『\"]?(?:吧|了|的|好|行|可以)",
    r"还是\s*(.{1,15})\s*(?:吧|好|了)",
    r"(?:那就|就|那)\s*[「『\"]?(.{1,20}?)[」『\"]?\s*(?:吧|了)",
    r"我?(?:决定|打算|准备)\s*(.{1,30})",
    r"(?:最后|最终|定了|确定了|拍板)\s*(?:还?是|就|搞|选|用|要)?\s*[「『\"]?(.{1,30}?)[」『\"]?\s*(?:吧|了|的|好|行)",
    r"(?:I'?ll\s+)?go\s+with\s+(.{1,30})",
    r"choose\s+(.{1,30})",
    r"(?:let'?s|I'?ll)\s+(?:do|try|use|take|pick)\s+(.{1,30})",
    r"(?:decided|going\s+with|picking)\s+(.{1,30})",
    r"(?:actually|scratch\s+that|on\s+second\s+thought|never\s+mind)[,.\s]*(?:let'?s\s+)?(?:do|go\s+with|try|use|take)\s+(.{1,30})",
)
ACTIONS = (
    r"(?:用|装|上|搞|跑|开|关|删|加|换|切)\s*[「『\"]?(.{1,20}?)[」『\"]?\s*(?:吧|了|的|掉)",
    r"(?:do|run|use|install|start|stop|delete|add|switch)\s+(.{1,20})",
)
GIVE_UP = ("不管了", "随便", "就那样", "算了", "不搞了", "放弃", "whatever", "never mind", "fine", "give up", "I'm done")
NO_CHOICE = ("还是", "就是", "不是", "just", "not", "or", "maybe", "either")

# Lines that state something, and starts of lines that ask.
STATEMENT = "(是|住在|位于|使用|用的是|喜欢|需要|想要|计划|买了|定了|预约了|申请了)"
QUESTION = r"^(\?|！|怎么|为什么|如何)"

# Facts by three or two groups; two groups take one relation.
FACT_THREE = (
    r"([一-鿿A-Za-z0-9_.@+-]{2,30})的([一-鿿A-Za-z0-9]{2,12})是([^\n，。；;]{2,60})",
    r"([一-鿿A-Za-z0-9_.@+-]{2,40})是([一-鿿A-Za-z0-9]{2,20})(?:的|的成员|的一员)([一-鿿A-Za-z0-9_.@+-]{2,40})",
    r"([一-鿿A-Za-z0-9_.@+-]{2,20})(邮箱|电话|手机|地址|住址|生日|名字|姓名|邮编|车牌|公司|职位|网站|域名|账户|账号)(?:是|为|：|:)([^\n，。；;]{2,60})",
)
FACT_TWO = (
    r"([一-鿿A-Za-z0-9_.@+-]{2,30})(?:住在|位于|使用|用的是|常用|主要用)([^\n，。；;]{2,60})",
    r"(?m)^([一-鿿A-Za-z0-9_.@+-]{2,30})是([^\n，。；;]{2,60})$",
)
#: What a text must hold, one word of each group, for the pattern of that place to match: most texts are settled by it.
FACT_THREE_NEED = (
    (("的",), ("是",)),
    (("的",), ("是",)),
    (("邮箱", "电话", "手机", "地址", "住址", "生日", "名字", "姓名", "邮编", "车牌", "公司", "职位", "网站", "域名", "账户", "账号"), ("是", "为", "：", ":")),
)
FACT_TWO_NEED = ((("住在", "位于", "使用", "用的是", "常用", "主要用"),), (("是",),))
FACT_RELATION = "住在"
ALIASES = {"我": "user", "本人": "user", "用户": "user", "我们": "user", "我的": "user"}

# What a person says of themselves, by kind; the first group is what is kept.
PERSONA = {
    "角色": [r"我是(.+?)(?:[，。！\n]|$)", r"我做(.+?)(?:[，。！\n]|$)", r"I am (.+?)(?:[.,!?\n]|$)", r"I work as (.+?)(?:[.,!?\n]|$)"],
    "工具": [r"(?:用|装|配|跑)(?:了|过)?\s*([A-Za-z][A-Za-z0-9._\-\s]{2,20})", r"(?:using?|running?|installed?)\s+([A-Za-z][A-Za-z0-9._\-]{2,20})"],
    "偏好": [r"我(?:喜欢|偏好|习惯|爱)\s*(.{2,30})", r"我(?:不喜欢|讨厌|烦)\s*(.{2,30})", r"I (?:like|love|prefer|enjoy)\s+(.{2,60})", r"I (?:hate|dislike|don't like)\s+(.{2,60})"],
    "决策": [r"(免费|不花钱|自己搞|省钱|性价比|开源)", r"(花钱|省事|付费|买|效率优先)", r"(free|open.source|diy|cheap|cost.effective)", r"(pay|buy|subscribe|premium)"],
}
