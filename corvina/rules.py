"""Word lists, codes and labels that results must agree on. Data, not logic."""

# Rank names of awards, the two that say "none" last.
RANKS = ("特別獎第一名", "特別獎第二名", "特別獎第三名", "第一名", "第二名", "第三名", "第四名", "大會獎佳作", "佳作", "一等獎", "二等獎", "三等獎", "四等獎", "成就證書", "特別獎", "未得獎作品", "無")
NO_RANK = ("未得獎作品", "無")
UNAWARDED = "未得獎"
# Spellings of special awards that are put right, as (written, meant).
SPECIAL_SPELLINGS = (("團體合作獎", "團隊合作獎"), ("團隊會作獎", "團隊合作獎"))
TOP_RANKS = ("第一名", "第二名", "第三名", "一等獎", "二等獎", "三等獎", "特別獎第一名", "特別獎第二名", "特別獎第三名")
MERIT_RANKS = ("佳作", "四等獎", "第四名", "大會獎佳作", "成就證書", "特別獎")
AWARD_FACETS = ("top", "merit", "special", "none", "unknown")

# Counties before 2010 and the cities that they are now.
OLD_COUNTIES = (("臺北縣", "新北市"), ("桃園縣", "桃園市"), ("臺中縣", "臺中市"), ("臺南縣", "臺南市"), ("高雄縣", "高雄市"))
CITIES = ("臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣")
# Towns and well-known schools, in the order in which they are tried.
TOWNS = (
    ("臺灣師範大學", "臺北市"), ("臺北教育大學", "臺北市"), ("高雄師範大學", "高雄市"), ("鳳山", "高雄市"), ("鳳新", "高雄市"), ("岡山", "高雄市"), ("旗美", "高雄市"),
    ("羅東", "宜蘭縣"), ("蘭陽", "宜蘭縣"), ("武陵", "桃園市"), ("中壢", "桃園市"), ("潮州", "屏東縣"), ("板橋", "新北市"), ("新莊", "新北市"), ("三重", "新北市"),
    ("民雄", "嘉義縣"), ("員林", "彰化縣"), ("秀水", "彰化縣"), ("科學工業園區", "新竹市"), ("中科實驗", "臺中市"), ("東華大學", "花蓮縣"), ("竹北", "新竹縣"),
    ("斗六", "雲林縣"), ("虎尾", "雲林縣"), ("北港", "雲林縣"), ("玉里", "花蓮縣"), ("馬公", "澎湖縣"), ("金門", "金門縣"), ("澎湖", "澎湖縣"), ("馬祖", "連江縣"),
    ("豐原", "臺中市"), ("大甲", "臺中市"), ("竹南", "苗栗縣"), ("埔里", "南投縣"),
)
# Cities whose first two characters alone name them.
SHORT_CITIES = ("臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "嘉義市", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣")

# Patterns of school names (台 for 臺), in order, and the stage that each means.
SCHOOL_STAGES = (
    (r"附設國[民]?中|\(國中部\)|國中部|附設國民中學", "國中"),
    (r"國民小學|國小|實驗小學|實小|小學", "國小"),
    (r"國民中學|國中", "國中"),
    (r"高級工業|高工|高級商業|高商|高級農|高農|高級職業|高職|家商|家事|海事|工商|工家|農工|商工|高級海", "高職"),
    (r"高級中學|高中|高級中等|完全中學|中學|實驗學校|女中", "高中"),
    (r"大學|學院", "大學"),
)
AMBIGUOUS_SCHOOL = r"財團法人|中小學|附屬|實驗|國際|美國學校|台商|臺商|私立.*(高級中學|中學)|完全中學|學院"
GROUP_STAGES = (("國小組", "國小"), ("國中組", "國中"), ("高級中等學校組", "高中職"))
FILE_GROUP_STAGES = (("國小組", "國小"), ("國中組", "國中"), ("高中組", "高中"), ("高職組", "高職"), ("初小組", "國小"), ("高小組", "國小"), ("國小教師組", "國小"), ("國中教師組", "國中"), ("高中教師組", "高中"))
CODE_STAGES = (("03", "國中"), ("04", "高中"), ("05", "高中職"), ("08", "國小"), ("09", "高職"))
SUBJECT_STAGE = r"^(國小|國中|高中|高職)組"
STAGES = ("國小", "國中", "高中職", "未標示")
STAGE_SOURCES = (("作品編號", "官方（作品編號）"), ("官網組別", "官方（組別列表）"), ("官網科別", "官方（科別欄）"), ("推測", "推測（依學校名稱）"))
# Groups as file names have them, by stage.
STAGE_GROUPS = (("國小", "國小組"), ("國中", "國中組"), ("高中", "高中組"), ("高職", "高職組"), ("高中職", "高中組"))

NATIONAL, INTERNATIONAL = "全國", "國際"
WORK, REVIEW = "作品", "評語"
CODE_IN_FILENAME = r"(?:nphssf|NPHSF)\d{4}-(\d{6})"
#: Pages of records, by contest.
RECORD_URL = "https://www.ntsec.edu.tw/science/detail.aspx?a=%s&sid=%s"
RECORD_PAGES = ((NATIONAL, "21"), (INTERNATIONAL, "90"))
FIELDS = ("作品名稱", "科展類別", "屆次", "科別", "得獎情形", "學校名稱", "指導老師", "作者", "關鍵字", "摘要或動機", "檔案連結")

# Headings: what a title contains, in order, and the kind of section that it opens.
SECTION_KINDS = (("目的", "研究目的"), ("問題", "研究目的"), ("設備", "研究設備及器材"), ("器材", "研究設備及器材"), ("儀器", "研究設備及器材"), ("材料", "研究設備及器材"), ("方法", "研究過程或方法"), ("過程", "研究過程或方法"), ("架構", "研究過程或方法"), ("結果", "研究結果"), ("討論", "討論"), ("結論", "結論"), ("應用", "結論"))
NUMERALS = ("壹貳參肆伍陸柒捌玖拾", "一二三四五六七八九十")
HEADINGS = (
    r"^\s*([壹貳參参肆伍陸柒捌玖拾]{1,3})\s*[、﹑.．]\s*(.{1,30}?)\s*$",
    r"^\s*([一二三四五六七八九十]{1,3})\s*[、﹑.．]\s*(.{1,30}?)\s*$",
    r"^\s*()((?:研究|實驗)?(?:動機|目的|設備|器材|過程|方法|結果|討論|結論)[^\n]{0,12}?)\s*$",
)
CONTENTS_LINE = r"(\.{3,}|…{2,}|\s\d{1,3})$"
GARBLED = "[ˣǵ烉炻ˤᶳᶲㆹ冯⃱屛]"
ODD_SCRIPT = "[Ѐ-ӿ֐-᳿ǀ-ɏ]"
SECRET = r"(?:sk-|AIza|ghp_|gho_|xox[abp]-)[A-Za-z0-9_\-]{16,}|(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]{40,})(?=\S*[a-z])(?=\S*[A-Z])(?=\S*\d)[A-Za-z0-9_\-]{40,}"
NAME_MASK, SECRET_MASK, CUT_MARK = "〔作者〕", "〔已移除疑似金鑰〕", "…（節錄）"
