"""Categories, priorities, words, patterns and texts that results must have as they are."""

# category: label, default placeholder, risk
CATEGORIES = {
    "entityA": ("主体A", "【主体A】", "high"),
    "entityB": ("主体B", "【主体B】", "high"),
    "entityC": ("主体C", "【主体C】", "high"),
    "entityD": ("主体D", "【主体D】", "high"),
    "entityE": ("主体E", "【主体E】", "high"),
    "entityF": ("主体F", "【主体F】", "high"),
    "entityG": ("主体G", "【主体G】", "high"),
    "entityH": ("主体H", "【主体H】", "high"),
    "entityI": ("主体I", "【主体I】", "high"),
    "entityJ": ("主体J", "【主体J】", "high"),
    "entityOther": ("相关主体", "【相关主体】", "high"),
    "person": ("人员姓名", "【联系人】", "high"),
    "address": ("地址", "【地址】", "high"),
    "project": ("项目或采购标的", "【项目A】", "medium"),
    "email": ("邮箱", "【邮箱已删除】", "high"),
    "phone": ("联系方式", "【联系方式已删除】", "high"),
    "idCard": ("身份证号", "【身份证号已删除】", "high"),
    "creditCode": ("统一社会信用代码", "【统一社会信用代码已删除】", "high"),
    "bankAccount": ("银行账号", "【银行账号已删除】", "high"),
    "bankName": ("开户行", "【开户行已删除】", "high"),
    "amount": ("金额", "【金额】", "medium"),
    "percentage": ("百分比", "X%", "medium"),
    "ratio": ("比例", "【比例】", "medium"),
    "installment": ("分期安排", "X期", "medium"),
    "numericSpec": ("技术数值", "X", "medium"),
    "contractNumber": ("文档编号", "【文档编号】", "high"),
    "date": ("日期", "20XX年XX月XX日", "medium"),
    "duration": ("期限", "Y日", "medium"),
    "custom": ("自定义敏感词", "【敏感信息】", "medium"),
}
ENTITY_LETTERS = "ABCDEFGHIJ"
PRIORITY = {"contractNumber": 18, "idCard": 17, "creditCode": 16, "bankAccount": 15, "bankName": 14, "email": 13, "phone": 12, **{f"entity{x}": 11 for x in (*ENTITY_LETTERS, "Other")}, "address": 10, "person": 9, "project": 8, "custom": 7, "date": 6, "duration": 5, "installment": 4, "ratio": 3, "percentage": 2, "numericSpec": 1, "amount": 0}
BATCH_GROUPS = {"amount": ("amount",), "spec": ("numericSpec", "percentage", "ratio", "installment"), "time": ("date", "duration")}
DELETED = "【已删除】"

SPEC_UNIT = "(?:min|ms|GU|[μµΜ]m|um|nm|mm|cm|km|m²|㎡|平方米|平方|平米|米|kg|mg|g|ml|mL|L|kW|W|V|A|MPa|kPa|Pa|℃|°C|°|H|h|m|s|d|y|户|名|轮|件|级|次|套|个|台|组|批|栋|层|楼|号楼|年|个月|月|周|天|日|小时|分钟|秒|毫秒)"
CHINESE_NUMBER = "[零〇一二两三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟萬億]+"
COMPANY_SUFFIX = "(?:公司|集团|中心|企业|事务所|研究院|研究所|委员会|银行|学校|大学|学院|医院|协会|基金会|机关|单位)"
COMPANY = f"[\\u4e00-\\u9fa5A-Za-z0-9（）()·&＆.\\-—_、 \\t　\\r\\n]{{2,90}}{COMPANY_SUFFIX}"
PARTY_LABEL = "甲方|乙方|丙方|丁方|戊方|己方|庚方|辛方|壬方|癸方"
CURRENCY = "(?:人民币|港币|港元|美元|美金|欧元|英镑|日元|日币|澳元|加元|新加坡元|新币|CNY|RMB|HKD|USD|EUR|GBP|JPY|AUD|CAD|SGD)"
SYMBOL = "(?:HK\\$|US\\$|CNY|RMB|USD|EUR|GBP|JPY|HKD|¥|￥|\\$|€|£)"
CAPITALS = "[零〇壹贰叁肆伍陆柒捌玖拾佰仟萬万億亿兆]{1,50}"
CAPITAL_UNIT = f"(?:(?:元|圆|万元|萬元|亿元|億元)(?:{CURRENCY})?|美元|美金|港元|港币|欧元|英镑|日元|澳元|加元|新加坡元|新币)"
CAPITAL_TAIL = "[零〇壹贰叁肆伍陆柒捌玖拾佰仟角分]*(?:整|正)?"
FOREIGN = "美元|美金|港元|港币|欧元|英镑|日元|澳元|加元|新加坡元|新币"
COMPARE = "(?:>=|<=|=>|=<|≥|≤|≈|≃|≅|≒|>|<|=|~)"
WAN = "万(?!\\s*(?:平方米|平方|平米|㎡|m²))"
GROUPED = "(?:\\d{1,3}(?:[,，]\\d{3})+|\\d+)(?:\\.\\d{1,2})?"
SAID = f"(?:大写\\s*[：:]?\\s*)?(?:{CURRENCY}\\s*)?{CAPITALS}{CAPITAL_UNIT}?{CAPITAL_TAIL}"
YEAR, MONTH, DAY = "(?:20\\d{2}|19\\d{2})", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12]\\d|3[01])"
# Numbers never give a digit back: nothing that follows one in a rule begins with a digit or a point
NUM, HAN = "\\d++(?:\\.\\d++)?+", "[零〇一二两三四五六七八九十百]+"
SPAN = "(?:个?(?:自然日|工作日|月)|天|日|周|小时|年)"
TO = "\\s*[-—–~至]\\s*"
CLAUSE_UNITS = "个?(?:自然日|工作日|月)|天|日|周|小时|分钟|秒|毫秒|年|亿元|万元|万|元|%|％|轮|件|级|次|套|台|批"

CLAUSE_ORDINAL = f"^第(?:\\d+|{CHINESE_NUMBER})(?:条|款|章|节|项)"
CLAUSE_WRAPPED = f"^[（(【\\[]\\s*(?:\\d+(?:\\.\\d+)*|{CHINESE_NUMBER})\\s*[）)】\\]]"
CLAUSE_PLAIN = f"^(?:\\d+(?:\\s*[.．]\\s*\\d+)*|{CHINESE_NUMBER})"

# The detectors in order: id, category, pattern, case ignored, placeholder (a text, or a name of functions.detectors; None: the default)
DETECTORS = [
    ("D01", "email", "[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}", True, None),
    ("D02", "idCard", "(?<![0-9A-Z])\\d{17}[0-9Xx](?![0-9A-Z])", False, None),
    ("D03", "creditCode", "(?<![0-9A-Z])[0-9A-HJ-NPQRTUWXY]{18}(?![0-9A-Z])", False, None),
    ("D04", "phone", "(?<!\\d)(?:\\+?86[-\\s]?)?1[3-9]\\d{9}(?!\\d)|(?<!\\d)(?:0\\d{2,3}[-\\s]?)?\\d{7,8}(?!\\d)", False, None),
    ("D05", "phone", "(?<!\\d)(?:[（(]\\s*0\\d{2,3}\\s*[）)]|0\\d{2,3})[\\s　-]*\\d{3,4}[\\s　-]*\\d{4}(?!\\d)(?:\\s*[（(]\\s*(?:总机|转\\s*\\d+)\\s*[）)])?", False, None),
    ("D06", "bankAccount", "(?<!\\d)(?:\\d[ -]?){16,24}(?!\\d)", False, None),
    ("D07", "date", f"[【\\[]\\s*{YEAR}\\s*[】\\]]\\s*年\\s*[【\\[]\\s*{MONTH}\\s*[】\\]]\\s*月(?:\\s*[【\\[]\\s*{DAY}\\s*[】\\]]\\s*日)?", False, "bracketed_date"),
    ("D08", "amount", f"{CURRENCY}\\s*(?:金额|价款|费用)?大写\\s*[：:]\\s*[【\\[（(]?\\s*{CAPITALS}{CAPITAL_UNIT}?{CAPITAL_TAIL}\\s*[】\\]\\）)]?", True, "【金额】"),
    ("D09", "amount", f"(?:{CURRENCY}\\s*)?(?:¥|￥|\\$|€|£)?\\s*\\d{{1,3}}(?:[,，]\\d{{3}})+(?:\\.\\d{{1,2}})?\\s*[（(]\\s*{SAID}\\s*[）)]", True, "【金额】"),
    ("D10", "amount", f"(?:{CURRENCY}\\s*)?(?:¥|￥|\\$|€|£)?\\s*{GROUPED}\\s*(?:亿元|万元|{WAN}|元|{FOREIGN})(?:\\s*[（(]\\s*{SAID}\\s*[）)])?", True, "money"),
    ("D11", "amount", f"{COMPARE}\\s*{NUM}\\s*(?:亿元|万元|{WAN}|元)", False, "compared_money"),
    ("D12", "amount", f"{SYMBOL}\\s*[【\\[（(]?\\s*{GROUPED}\\s*[】\\]\\）)]?\\s*(?:元|万元|亿元|{FOREIGN})?", True, None),
    ("D13", "amount", "(?:人民币\\s*)?[【\\[]\\s*\\d+(?:\\.\\d{1,2})?\\s*(?:万|亿)?\\s*[】\\]]\\s*元", False, None),
    ("D14", "amount", "(?:人民币\\s*)?[【\\[]\\s*\\d+\\.\\d{1,2}\\s*[】\\]]", False, None),
    ("D15", "amount", f"(?:{CURRENCY}\\s*)?[【\\[]\\s*{CAPITALS}{CAPITAL_UNIT}?{CAPITAL_TAIL}\\s*[】\\]]", True, None),
    ("D16", "amount", f"(?:大写\\s*[：:]?\\s*)?(?:{CURRENCY}\\s*)?[【\\[（(]?\\s*(?:{CURRENCY}\\s*)?{CAPITALS}{CAPITAL_UNIT}{CAPITAL_TAIL}\\s*[】\\]\\）)]?", True, "【金额】"),
    ("D17", "amount", "(?<!\\d)\\d+(?:\\.\\d{1,2})?(?=\\s*元\\s*/\\s*[^/\\s，,；;。]{1,12}\\s*/\\s*(?:月|日|年))", False, "X"),
    ("D18", "amount", "(?<!\\d)\\d+(?:\\.\\d{1,2})?(?=\\s*[】\\]\\）)]?\\s*元(?![\\d]))", False, "X"),
    ("D19", "amount", f"(?:{CURRENCY}\\s*)?{CAPITALS}{CAPITAL_UNIT}{CAPITAL_TAIL}", True, None),
    ("D20", "amount", f"(?:\\d+(?:\\.\\d{{1,2}})?){TO}(?:\\d+(?:\\.\\d{{1,2}})?)\\s*(?:元|万元|亿元|{FOREIGN})", False, "money_range"),
    ("D21", "percentage", f"{NUM}\\s*[％%]{TO}{NUM}\\s*[％%]", False, "X%-Y%"),
    ("D22", "percentage", f"{NUM}\\s*[％%]", False, "X%"),
    ("D23", "percentage", f"百分之\\s*(?:{NUM}|{HAN})", False, "百分之X"),
    ("D24", "percentage", f"{NUM}\\s*‰{TO}{NUM}\\s*‰", False, "X‰-Y‰"),
    ("D25", "percentage", f"{NUM}\\s*‰", False, "X‰"),
    ("D26", "percentage", f"千分之\\s*(?:{NUM}|{HAN})", False, "千分之X"),
    ("D27", "ratio", f"(?:{NUM}|{HAN})分之(?:{NUM}|{HAN})", False, "X分之Y"),
    ("D28", "ratio", "一半|半数|过半", False, "【比例】"),
    ("D29", "ratio", f"{NUM}(?=\\s*[×xX*]\\s*(?:余款|价款|金额|费用|总额))", False, "X"),
    ("D30", "ratio", f"(?:{NUM}|[零〇一二两三四五六七八九十]+)(?:成|折)", False, "tenths"),
    ("D31", "installment", f"分\\s*[【\\[（(]?\\s*(?:\\d+|{HAN})\\s*期\\s*[】\\]\\）)]?", False, "分X期"),
    ("D32", "installment", f"(?:第\\s*)?(?:\\d+|{HAN})(?=\\s*期)", False, "nth"),
    ("D33", "numericSpec", f"{COMPARE}\\s*{NUM}", False, "compared"),
    ("D34", "numericSpec", f"{COMPARE}\\s*{NUM}\\s*{SPEC_UNIT}", True, "compared_unit"),
    ("D35", "numericSpec", f"{NUM}\\s*(?:-|—|–|~|到|至|to)\\s*{NUM}\\s*{SPEC_UNIT}", True, "range_unit"),
    ("D36", "numericSpec", f"(?:至少|至多|不少于|不低于|不高于|不超过|低于|高于|大于|小于|约|共|全部)?\\s*{NUM}\\s*{SPEC_UNIT}", True, "qualified_unit"),
    ("D37", "numericSpec", f"{NUM}\\s*(?:万|千|百)?\\s*(?:平方米|平方|平米|㎡|m²|米)", False, "area"),
    ("D38", "numericSpec", f"(?<![\\dA-Za-z]){NUM}\\s*{SPEC_UNIT}(?![A-Za-z])", True, "unit"),
    ("D39", "date", f"(?<!\\d){YEAR}年\\s?{MONTH}月\\s?{DAY}日(?!\\d)", False, None),
    ("D40", "date", f"(?<!\\d){YEAR}[.\\-/]{MONTH}[.\\-/]{DAY}(?!\\d)", False, "20XX年XX月XX日"),
    ("D41", "date", f"(?<!\\d){YEAR}年\\s?{MONTH}月(?!\\s?{DAY}日)(?!\\d)", False, None),
    ("D42", "date", f"(?<![\\d年]){MONTH}月\\s?{DAY}日(?!\\d)", False, None),
    ("D43", "duration", "(?:第)?\\s*[【\\[（(]?\\s*\\d+\\s*[】\\]\\）)]?\\s*[-—–~至]\\s*[【\\[（(]?\\s*\\d+\\s*[】\\]\\）)]?\\s*(?:个?月|周|天|日|小时|年)", False, "period_range"),
    ("D44", "duration", f"(?<![\\d年月])(?:[【\\[（(]\\s*)?(?:\\d+|{CHINESE_NUMBER})(?:\\s*[】\\]\\）)])?\\s*{SPAN}(?:\\s*[（(]\\s*(?:大写\\s*[：:]?\\s*)?{CHINESE_NUMBER}\\s*{SPAN}?\\s*[）)])?", False, "period"),
    ("D45", "amount", "(?:人民币\\s*)?(?:¥|￥)?\\s*\\d{1,3}(?:[,，]\\d{3})+(?:\\.\\d{1,2})?\\s*(?:元|万元|亿元)?|(?:人民币\\s*)?(?:¥|￥)\\s*\\d+(?:\\.\\d{1,2})?|\\d+(?:\\.\\d{1,2})?\\s*(?:万元|亿元)", False, None),
]

# Characters without which rules cannot match, in whole texts
NEEDS = {"at": "@", "digit": "\\d", "digits": "\\d{4}", "han": "[〇\\u4e00-\\u9fff]", "percent": "[％%]", "permille": "‰", "compare": "[><≥≤≈≃≅≒=~]"}
# What the fragment of a rule's match must hold, by rule: flags of fragments, strings of which one must be there, or /patterns/
_TO, _FOREIGN, _OPEN, _COMPARED = ("-", "—", "–", "~", "至"), ("美金", "港币", "英镑", "新币"), ("【", "["), tuple("><≥≤≈≃≅≒=~")
_MONEY, _CAPITAL, _SPAN = ("万", "元", *_FOREIGN), ("/[零〇壹贰叁肆伍陆柒捌玖拾佰仟萬万億亿兆]/",), ("天", "日", "周", "小时", "年", "月")
_DIGIT, _DIGITS = ("digit",), ("digits",)
RULE_NEEDS = {
    "D01": (("@",),), "D02": (_DIGITS,), "D03": (("/[0-9A-HJ-NPQRTUWXY]{18}/",),), "D04": (_DIGITS,), "D05": (_DIGITS,), "D06": (_DIGIT,), "D07": (_DIGIT, ("年",), ("月",)), "D08": (("大写",), _CAPITAL), "D09": (_DIGIT, (",", "，"), ("（", "("), _CAPITAL),
    "D10": (_DIGIT, _MONEY), "D11": (_DIGIT, ("万", "元"), _COMPARED), "D12": (_DIGIT, ("/[A-Za-z¥￥$€£]/",)), "D13": (_DIGIT, ("元",), _OPEN), "D14": (_DIGIT, (".",), _OPEN), "D15": (_OPEN, _CAPITAL),
    "D16": (("元", "圆", *_FOREIGN), _CAPITAL), "D18": (_DIGIT, ("元",)), "D19": (("元", "圆", *_FOREIGN), _CAPITAL), "D20": (_DIGIT, ("元", *_FOREIGN), _TO), "D21": (_DIGIT, ("%", "％"), _TO), "D22": (_DIGIT, ("%", "％")),
    "D23": (("百分之",),), "D24": (_DIGIT, ("‰",), _TO), "D25": (_DIGIT, ("‰",)), "D26": (("千分之",),), "D27": (("分之",),), "D28": (("半",),), "D29": (_DIGIT, ("余款", "价款", "金额", "费用", "总额")), "D30": (("成", "折"),),
    "D31": (("分",), ("期",)), "D32": (("期",),), "D33": (_DIGIT, _COMPARED), "D34": (_DIGIT, _COMPARED), "D35": (_DIGIT, (*_TO, "到", "t", "T")), "D36": (_DIGIT,), "D37": (_DIGIT, ("米", "平", "㎡", "m")), "D38": (_DIGIT,),
    "D39": (_DIGITS, ("年",), ("月",)), "D40": (_DIGITS,), "D41": (_DIGITS, ("年",), ("月",)), "D42": (_DIGIT, ("月",), ("日",)), "D43": (_DIGIT, _TO, _SPAN), "D44": (_SPAN,), "D45": (_DIGIT, (",", "，", "¥", "￥", "万元", "亿元")),
}
# Of the rules that are searched in whole texts: strings that must all be there
TEXT_NEEDS = {"D17": ("元", "/")}

SEP, GAP = "[：:，,.。\\s　]*", "[ \\t　]*"
NAME_CHARS = "\\u4e00-\\u9fa5·A-Za-z"
NAME_END = f"(?={GAP}(?:电话|手机|邮箱|电邮|传真|联系人|联系人及联系方式|授权代表|地址|姓名|职务|岗位|[；;，,.。|]|\\n|$))"
# Labelled fields in order: id, category, label, value, what follows, flags, placeholder
FIELDS = [
    ("L01", "contractNumber", f"(?:授权书编号|委托书编号|声明函编号|文书编号|文档编号|函件编号|合同编号|合同号|协议编号|协议号|订单编号|项目编号){SEP}", "[【\\[（(]?[A-Za-z0-9\\u4e00-\\u9fa5._/—–\\-]{3,80}[】\\]\\）)]?", "", "", "【文档编号】"),
    ("L02", "address", f"(?:地址(?:、|及)电话){SEP}", "[^\\n|；;]{4,120}", "", "", "【地址及联系方式】"),
    ("L03", "address", f"(?:{PARTY_LABEL}){SEP}(?:公司名称{SEP}[^\\n|；;]{{2,80}})?{SEP}地址{SEP}", "[【\\[]?[^\\n|；;】\\]]{4,120}[】\\]]?", "", "", "【地址】"),
    ("L04", "address", f"(?:注册地址|办公地址|通讯地址|通信地址|送达地址|联系地址|开票地址|发票地址|账单地址|住所地|住所|经营场所|项目地址|服务地址|交付地址|收货地址|履约地点|(?:(?<![^\\n])|[\\n|]){GAP}地址){SEP}", "[【\\[]?[^\\n|；;】\\]]{4,120}[】\\]]?", "", "", "【地址】"),
    ("L05", "address", f"(?:位于|坐落于|所在地为|项目地点为|工程地点为|工程地址为){SEP}", "[^\\n，,；;。|]{4,120}", "", "", "【地址】"),
    ("L06", "person", f"(?:收件人|收货人|接收人){GAP}[：:；;，,.。]?{GAP}", "[【\\[][^】\\]\\n|；;]{2,40}[】\\]]", "", "", "【收件人】"),
    ("L07", "person", f"(?:联系人及联系方式|联系人和联系方式|联系人/联系方式|联系人、联系方式){GAP}[：:；;，,.。]?{GAP}", f"[{NAME_CHARS}][{NAME_CHARS} \\t　]{{1,20}}", f"(?={GAP}(?:电话|手机|邮箱|电邮|传真|$))", "", "【联系人】"),
    ("L08", "person", f"(?:法定代表人\\s*[（(]\\s*或\\s*授权代表\\s*[）)]|授权人|授权代表|签字人|签字代表|签署人|委托代理人|发包人代表|承包人代表|项目经理|项目负责人|总监理工程师)(?:[（(][^）)\\n]{{1,12}}[）)])?(?:姓名|名称|岗位|职务)?(?:{GAP}[：:；;，,.。]{GAP}|[ \\t　]+)", f"[【\\[][^】\\]\\n|]{{2,60}}[】\\]]|[（(][^）)\\n|]{{2,60}}[）)]|[{NAME_CHARS}][{NAME_CHARS} \\t　]{{1,28}}?", NAME_END, "", "【授权代表信息】"),
    ("L09", "person", f"(?:联系人|收件人|收货人|接收人|经办人|法定代表人|负责人|授权代表|委托代理人|发包人代表|承包人代表|项目经理|项目负责人)(?:[（(][^）)\\n]{{1,12}}[）)])?(?:姓名|岗位|职务)?(?:{GAP}[：:，,.。]{GAP}|[ \\t　]+)", f"(?:[【\\[（(][\\s　]*)?[{NAME_CHARS}][{NAME_CHARS} \\t　]{{1,28}}?", NAME_END, "", "【联系人】"),
    ("L10", "person", f"(?:姓名|姓\\s*名|职务|岗位){GAP}[：:，,.。]{GAP}", f"[【\\[（(]?{GAP}[{NAME_CHARS}][{NAME_CHARS} \\t　]{{1,28}}[】\\]\\）)]?", "", "", "【人员信息】"),
    ("L11", "bankName", f"(?:开户行|开户银行)(?:及|、)(?:账号|帐号){SEP}", "[^\\n；;]{4,120}", "", "", "【开户行及账号已删除】"),
    ("L12", "bankName", f"(?:开户银行|账户开户行|开户行){SEP}", "[^\\n；;]{2,80}", "", "", "【开户行已删除】"),
    ("L13", "amount", f"(?:金额大写|价款大写|费用大写|大写){SEP}", f"(?:{CURRENCY})?[\\s　]*[【\\[（(]?\\s*(?:{CURRENCY}\\s*)?{CAPITALS}{CAPITAL_UNIT}?{CAPITAL_TAIL}\\s*[】\\]\\）)]?", "", "(?i)", "【金额】"),
    ("L14", "amount", f"(?:合同总额|合同金额|费用总额|服务费用|服务费|含税金额|不含税金额|价款|租金|违约金|保证金|押金|单价|金额){SEP}", f"(?:{CURRENCY}|{SYMBOL})?[\\s　]*[【\\[（(]?[\\s　]*{GROUPED}[\\s　]*(?:万|亿)?[\\s　]*[】\\]\\）)]?[\\s　]*(?:元|{FOREIGN})?", "", "(?i)", "【金额】"),
    ("L15", "amount", f"(?:合同总额|合同金额|费用总额|服务费用|服务费|含税金额|不含税金额|价款|租金|违约金|保证金|押金|金额){SEP}", f"(?:{CURRENCY})?[\\s　]*[【\\[（(]?[\\s　]*(?:{CURRENCY}\\s*)?{CAPITALS}{CAPITAL_UNIT}?{CAPITAL_TAIL}[\\s　]*[】\\]\\）)]?", "", "(?i)", "【金额】"),
    ("L16", "numericSpec", f"(?:范围|区间|标准要求|参数|结果(?:为)?){SEP}", f"{NUM}\\s*(?:-|—|–|~|到|至|to)\\s*{NUM}", "", "(?i)", "X-Y"),
    ("L17", "project", "(?:项目名称|项目代号|采购标的|产品名称|双方就)[：:\\s“\"]+", "[^\\n，”\"；;]{2,50}", "", "", None),
]
# Words of which a text must hold one for a field's label
FIELD_WORDS = {
    "L01": ("编号", "合同号", "协议号"), "L02": ("地址",), "L03": ("地址",), "L04": ("地址", "住所", "经营场所", "履约地点"), "L05": ("位于", "坐落于", "所在地为", "地点为", "地址为"), "L06": ("收件人", "收货人", "接收人"), "L07": ("联系方式",),
    "L08": ("代表", "授权人", "签字人", "签署人", "代理人", "项目经理", "负责人", "监理工程师"), "L09": ("联系人", "收件人", "收货人", "接收人", "经办人", "代表", "负责人", "代理人", "项目经理"), "L10": ("姓", "职务", "岗位"), "L11": ("开户",), "L12": ("开户",),
    "L13": ("大写",), "L14": ("总额", "金额", "服务费", "价款", "租金", "违约金", "保证金", "押金", "单价"), "L15": ("总额", "金额", "服务费", "价款", "租金", "违约金", "保证金", "押金"), "L16": ("范围", "区间", "标准要求", "参数", "结果"),
    "L17": ("项目名称", "项目代号", "采购标的", "产品名称", "双方就"),
}
PROJECT_TOKENS = {"tech": "【技术项目A】", "purchase": "【采购标的A】", "": "【项目或标的A】"}

# Values of persons and addresses
WRAPPERS = "^[【\\[（(\\s　]+|[】\\]\\）)\\s　]+$"
PROSE = "(?:已获得|获得法定|法定资格|应当|应为|有权|无权|可以|不得|签署本|签订本|或授权|以及|并且)"
BLANK_FORM = "^(?:待填写|未填写|待补充|未提供|授权范围|委托事项|姓名|姓\\s*名|名称|名\\s*称|职务|岗位|地址|通讯地址|通信地址|联系电话|电子信箱|电子邮箱)$"
ADDRESS_WORDS = "(?:下述|上述|相关方|书面通知|电邮地址|传真号码|其他地址)"
PLACE = "(?:省|市|区|县|镇|乡|村|路|街|道|巷|号|楼|室|座|层|大厦|广场|园区|开发区|自治区|特别行政区)"
PLACE_DETAIL = "\\d|号|室|楼|座|层|园|区|路|街|道|村|镇"
LECTURER = "(?:讲师|培训讲师|授课老师|授课教师|主讲人)[ \\t　]*(?:为|是)?[：:，,.。\\s　]*"
LAWYER_CLAUSE = "(?:指派|委托|聘请|保证|由)[^。\\n；;]{0,100}律师[^。\\n；;]{0,80}"
LAWYER_ROLES = "(?:主办|代理|承办|团队|人员|合伙|本案|出庭)"

# What is cut from a party's value
AFTER_VALUE = "(?:统一社会信用代码|纳税人识别号|地址|电话|联系人|法定代表人)"
AFTER_NAME = "[（(【\\[]\\s*(?:以下简称|以下称|后称|简称|略称)"
AROUND_VALUE = "^[ \\t　【\\[（(：:，,.。]+|[ \\t　】\\]）)：:，,.。]+$"

# Parties
PARTIES = [("甲", "甲方|采购方|买方"), ("乙", "乙方|供应方|卖方"), ("丙", "丙方"), ("丁", "丁方"), ("戊", "戊方"), ("己", "己方"), ("庚", "庚方"), ("辛", "辛方"), ("壬", "壬方"), ("癸", "癸方")]
PARTY_GAP = f"(?:{GAP}[：:，,.。]{GAP}(?:(?:\\|{GAP})|(?:\\n{GAP}))?|[ \\t]*　+{GAP}|[ \\t]{{2,}}|{GAP}\\|{GAP}|{GAP}\\n{GAP}|{GAP}(?=[【\\[]))"
PREAMBLE_END = "\\n[ \\t　]*(?:#{1,6}[ \\t　]*)?(?:第[一二三四五六七八九十百千0-9]+(?:条|章)|第一部分)[ \\t　]"
PREAMBLE_CHARS = 20000
ROLES = "被授权人|被授权方|授权人|授权方|委托人|受托人|委托方|受托方|声明人|声明方|承诺人|承诺方|出具方"
ROLE_NAME = f"(?:[^\\n：:；;，,|【\\]】]{{2,80}}{COMPANY_SUFFIX}|[\\u4e00-\\u9fa5·]{{2,4}}|[A-Za-z][A-Za-z .'-]{{1,48}})"
ROLE_LABEL = f"(?:^|[\\n|；;]){GAP}(?:{ROLES}){GAP}(?:[（(][^）)\\n]{{1,20}}[）)])?(?:名称|姓名)?{GAP}(?:[：:]{GAP}[|]?{GAP}[【\\[（(]?{GAP}|[【\\[])"
ROLE_END = f"(?={GAP}(?:[【\\[（(】\\]）)；;，,|]|\\n|$))"
ROLE_BLANK = "^(?:姓名|名称|待填写|未填写|授权范围|委托事项)$"
RELATED_LABEL = "(?:公司名称|单位名称|企业名称|主体名称|名\\s*称|监理人|设计人|发包人|承包人|代理人|采购人|供应商|服务商|收款方|付款方|第三方|相关方|户\\s*名|账户名|收款户名)"
RELATED_WORDS = ("称", "监理人", "设计人", "发包人", "承包人", "代理人", "采购人", "供应商", "服务商", "收款方", "付款方", "第三方", "相关方", "户")
ALIAS_BLOCKED = ["甲方", "乙方", "丙方", "丁方", "戊方", "己方", "庚方", "辛方", "壬方", "癸方", "双方", "各方", "本公司", "该公司", "一方", "对方", "授权人", "被授权人", "授权方", "被授权方", "委托人", "受托人", "委托方", "受托方", "声明人", "承诺人"]
ALIAS_WORDS = "以下简称|以下称|后称|简称|略称"
ALIAS_AFTER = f"[ \\t　]*[】\\]]?[ \\t　]*[（(【\\[][^\\n]{{0,30}}?(?:{ALIAS_WORDS})[：:，, \\t　]*(?:为[：:，, \\t　]*)?[“\"‘']?"
ALIAS_NAME = "[^”\"’'\\n，,；;）)\\]】]{1,20}"

# Document types
TYPES = {"authorization": "授权书", "mandate": "委托书", "statement": "声明或承诺文书", "letter": "业务函件", "contract": "通用合同", "tech": "技术合作开发合同", "purchase": "业务采购合同", "generic": "通用文书"}
HEADING = "^[\\u4e00-\\u9fa5A-Za-z0-9 ·（）()《》_-]{2,80}$"
HEADING_TYPES = [("mandate", "(?:授权委托书|委托书)[》）)]?$"), ("authorization", "授权书[》）)]?$"), ("statement", "(?:声明函|声明书|承诺函|承诺书)[》）)]?$"), ("letter", "(?:函|通知书)[》）)]?$")]
CONTRACT_WORD = "(?:合同|协议|契约)"
TECH_TERMS = ["技术开发", "合作开发", "研发", "技术成果", "技术指标", "知识产权", "源代码", "技术秘密"]
PURCHASE_TERMS = ["采购合同", "采购方", "供应方", "供应商", "采购标的", "货物", "供货", "订单", "质量保证"]
TYPE_NAME = "[\\u4e00-\\u9fa5A-Za-z0-9·（）()《》]{2,36}(?:合同|协议|契约)"
SELF_REFERENCE = "(?:本合同|本协议|签订合同|订立合同)$"

# Limits
MIB = 1024 * 1024
MARKDOWN_BYTES, PDF_BYTES, PART_BYTES, TOTAL_BYTES, ENTRIES, TEXT_CHARS = 10 * MIB, 30 * MIB, 2 * MIB, 8 * MIB, 1024, 200_000
PDF_PAGES, PDF_CHARS, SPARSE_CHARS = 200, 1_000_000, 30
HISTORY_DAYS, HISTORY_MOST, SAFE_INTEGER = 30, 100, 2**53 - 1
RUN_ID, VERSION = "^JQ-[a-f0-9-]{36}$", "^[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}\\.[0-9]+\\+[a-f0-9]{10}$"

# Texts
FOCUS = {
    "tech": "重点检查研发分工、技术成果、知识产权归属、验收、付款、保密、违约与退出机制。",
    "purchase": "重点检查采购标的、价格与税费、交付、验收、付款账期、质量责任、违约与争议解决。",
    "contract": "重点检查各方角色、权利义务、金额与付款、履行期限、验收、保密、违约、解除与争议解决。",
    "authorization": "重点检查授权人与被授权人的对应关系、授权事项、权限范围、地域、有效期、转授权条件、撤销与终止条件。",
    "mandate": "重点检查委托人与受托人的对应关系、委托事项、代理权限、期限、转委托条件、撤销与终止条件。",
    "statement": "重点检查出具主体、声明或承诺事项、适用对象、条件、例外、期限及责任边界。",
    "letter": "重点检查发出方与接收方、函件目的、事实陈述、要求或回应、期限及责任边界。",
    "generic": "先判断文本用途，再检查涉及的人物或组织、核心事项、条件、例外、期限及前后是否一致。",
}
PROMPT = ("请分析随附的脱敏版", "。\n\n", "\n\n请按以下结构输出：\n1. 核心内容摘要及相关各方角色；\n2. 不明确、矛盾或需核实的内容；\n3. 结合文书用途提出修改或补充建议，不机械套用合同条款清单；\n4. 如涉及风险，说明影响及判断依据；\n5. 每项判断引用对应段落或条款。\n\n请区分“原文明确载明”“原文未载明”“原值已隐藏”和“提取缺失”。不要猜测占位符对应的真实主体、金额、日期或项目，也不要把隐藏值当成原文漏填。因脱敏或提取缺失而无法判断的事项，请明确列出并要求本地回查原件。\n\n提示：AI 分析仅供参考，不能替代专业判断；涉及法律事项时应由律师或企业法务复核。")
NO_FINDINGS = "- 未发现自动识别项，仍需人工检查。"
DUTY = "本工具仅辅助识别敏感信息，导出前应由用户完成人工复核。AI 分析仅供参考，不能替代律师或企业法务的专业判断。"
PDF_NOTICE = "PDF 实验导入：本稿仅包含可提取文字的脱敏结果，不代表原 PDF 已脱敏或全文完整。图片、扫描内容、印章、批注、附件及元数据不纳入输出；隐藏文字层可能与画面不一致，表格与阅读顺序可能变化，请按页码对照原件。"
EMPTY_PAGE = "【此页未提取到文字，请对照原件补充；可能是扫描页、图片页或空白页。】"
PACKAGE_WARNINGS = ("文档包含图片；MVP 不读取图片内容，请人工检查图片中的敏感信息。", "文档包含批注；批注不会写入输出，请确认其中没有必须保留的文档内容。", "文档包含嵌入附件；附件未处理，请单独检查。")
PART_NOTICE = "\n\n---\n\n> 页眉或页脚内容\n\n"
