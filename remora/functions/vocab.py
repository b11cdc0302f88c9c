"""Fixed values of the query language: word lists, months, keyword tables and class patterns."""

#: Capitalised words that are no entities.
ENTITY_STOP = ["the", "and", "but", "for", "with", "you", "your", "this", "that", "there", "then", "they", "them", "when", "what", "which", "who"]

#: Words that the summary index leaves out.
SUMMARY_STOP = (
    "what when where who whom whose why how which did does do is are was were be been being the a an and or of to in on at for with "
    "by from as that this these those it its he she they them his her their you your we our about into than then there here not no yes "
    "的 了 是 在 和 与 有 我 你 他 她 它 什么 怎么 为什么 哪 哪个 多少 以及 这个 那个"
).split()

#: Words that the English side of the raw index leaves out.
ENGLISH_STOP = (
    "a an the and or but if then than that this these those there here is are was were be been being am do does did doing done have has had "
    "having i you he she it we they me him her us them my your his its our their what when where who whom whose why how which of to in on at "
    "for with by from as into about over under again further once not no nor only own same so too very can will just should now"
).split()

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Any spelling of a month, longest first.
MONTH = "january|february|march|april|may|june|july|august|september|sept|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"

#: Task types and the keywords that count for them, in order of precedence.
TASK_KEYWORDS = {
    "决策": ["决定", "选", "选择", "方案", "怎么办", "应该", "建议", "好还是", "权衡", "利弊", "决策", "怎么做"],
    "规划": ["计划", "打算", "准备", "要做", "设计", "架构", "蓝图", "路线", "规划", "方案", "先计划", "工作流"],
    "验证": ["测试", "验证", "证明", "确认", "对不对", "是不是", "检验", "核实", "verify", "test"],
    "研究": ["研究", "探索", "学习", "了解", "分析", "调查", "资料", "文献", "research", "原理"],
    "闲聊": ["聊", "说说", "谈谈", "好玩", "有趣", "哈哈", "有意思", "闲聊"],
    "求助": ["帮", "帮忙", "求助", "求救", "解决", "bug", "报错", "error", "失败", "出错"],
    "事实": ["是什么", "是啥", "什么是", "定义", "意思是", "简称", "全称"],
}
#: The closed vocabulary that answers are normalised to, and its fallback.
TASK_TYPES = ["研究", "决策", "验证", "规划", "闲聊", "求助"]
TASK_FALLBACK = "其他"

#: Question classes in order of trial: class, Chinese pattern, English pattern.
CLASSES = [
    ("C1", r"我(是不是|有没有)(跟你|和你)?(说|提|讲|聊)过|我(之前|以前|上次)?(说|提|讲)过吗|你有没有(记录|提过)|是不是没有", r"\bdid (i|we) (ever )?(mention|tell|say|talk about)\b|\bhave i (ever )?\b|\bdo you (remember|recall)\b.{0,30}\b(mention|tell)\b"),
    ("D2", r"以前(是|怎么)|之前是|后来(为什么|怎么)|改过|取代|旧版|最新版|历史上|演变|什么时候改的|为什么改了|现在和以前", r"\bpreviously\b|\bearlier\b|\bused to\b|\bsupersed|\bold version\b|\bchanged (from|to)\b|\bbefore\b.{0,20}\b(change|update|modif)"),
    ("D1", r"^(那个|这个|它|他|她|那些|这些)呢|^(那个|这个)呢|接着上次|上面(那个|说的)|你说的那个|后来呢|然后呢", r"^(that|this|it|those|these)\b|\bthe (same|above|previous) one\b"),
    ("E1", r"怎么(启动|运行|配置|安装|重建|打包)|在(哪|什么)个?(目录|路径|端口)|路径|端口|命令|脚本在", r"\bhow (do|can|should) i (start|run|install|configure|rebuild)\b|\bwhere (is|are) the\b|\bwhat port\b|\bwhich (file|script|command)\b"),
    ("B2", r"你觉得|你认为|你怎么(看|想)|为什么|会不会|是不是因为|推测|估计|建议|该不该|怎么办|怎么看|看法|值得吗|应该(怎么|如何)", r"\b(would|might|likely|probably|possibly|could)\b|\bwhy\b|\bwhat (kind|sort) of\b|\bwho is\b|\bwhat is\b.{0,24}\blike\b|\bwhat (do you think|would|could)\b|\bhow (would|could|should)\b|\bdo you think\b"),
    ("B1", r"都(有|是|说|做|用|包含)|全部|所有|列(出来|一下|个)|有哪些|哪些|一共|总共|分别|比一比|对比一下|清单|整理(一下|成)|归类|分几类|多少个", r"\bwhat\b[\w\s'+&/-]{0,24}\b(activities|events|books|hobbies|things|places|countries|pets|jobs|sports|foods|movies|songs|games|gifts|topics|subjects|projects|ways|types|kinds|dreams)\b|\bwhere (has|have|did)\b|\bwhat (do|does|did)\b.{0,40}\b(like|enjoy|partake|participate|collect|play|read|watch|listen|do)\b|\blist\b|\ball the\b"),
    ("A3", r"对吧|对吗|是不是真的|我(说过|要求过|提过|定过).{0,12}(吗|吧)|确定.{0,8}吧", r"\b(am i right|correct me|right\?|correct\?)\b|^\s*(is|are|did|does|was|were)\b.{0,60}\b(right|correct)\b"),
    ("A2", r"什么时候|哪天|哪一天|几号|多久|多长时间|隔了|先后|时间线|几月|哪年|那天", r"\bwhen\b|\bhow long\b|\bwhat (day|date|year|month)\b|\bhow many (days|weeks|months|years)\b"),
    ("A1", r"是什么|叫什么|什么是|是谁|在哪|多少|几个|怎么做|怎么用|如何", r"\b(what|who|where|which|whose)\b"),
]
CLASS_FALLBACK = "A1"
#: class -> (top k, delivery, dedupe) after a parent's policy is overridden by its child's.
POLICY = {"A": (15, "raw", False), "B": (30, "raw", True), "C": (15, "raw", False), "D": (20, "raw", True), "E": (10, "summary", False)}
CHILD_POLICY = {"B2": (15, "summary", False)}

RECENT = r"(?i)\b(latest|most recent|recently|these days|right now|currently|nowadays|last time|as of now)\b|最新|最近的|最近|目前|现在|当下|上次|这一次|当前"
UNITS = "%|percent|dollars?|days?|weeks?|months?|years?|hours?|minutes?|stars?|miles?|mpg|times?|people|engineers?|books?|songs?|bikes?|plants?|items?|pieces?|pages?|episodes?|shirts?|festivals?|cuisines?"
