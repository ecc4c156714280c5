"""Fixed values of the document rules: patterns, character classes, keyword lists.

Patterns are in the syntax that Java's and RE2's engines share; ``py`` gives Python's. Users put the flags in
front: IU for Unicode classes and any case.
"""

IU = "(?iU)"

# Character classes and token patterns.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
TOKEN = rf"[{CJK}]|[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|\d+(?:\.\d+)?|[^\s]"
WORD = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
SEARCH_TOKEN = rf"[{CJK}]|{WORD}"
SENTENCE_ENDS = "。！？；.!?;\n"
TRAILING_MARKS = "，。！？；：、,.!?;:%)]}"
OPENING_MARKS = "([{/"

# Patterns of reference lists, front matter and page noise.
_REFERENCE_NAMES = r"references(?:\s+and\s+notes)?|bibliography|参考文献|参考资料|works\s+cited|literature\s+cited"
REFERENCE_HEADING = rf"^\s*({_REFERENCE_NAMES})\s*[:：]?\s*$"
REFERENCE_SECTION = rf"(^|[>\n\r]\s*)({_REFERENCE_NAMES})\s*[:：]?\s*$"
BIBLIOGRAPHY_MARKER = r"(\bdoi\s*:|\bDOI\s*:|\bet\s+al\.?|\[[JMC]\]|,\s*\d{4}\s*,\s*\d+\s*\(\s*\d+\s*\)\s*:\s*\d+[-–]\d+|\bVol\.\s*\d+|\bNo\.\s*\d+)"
PUBLICATION_HEADER = r"^\s*(vol\.\s*\d+.*no\.\s*\d+.*|.*第\s*\d+\s*卷.*第\s*\d+\s*期.*|.*\bissn\b.*|.*\bjournal\s+of\b.*\bvol\.\b.*)\s*$"
FRONT_MATTER = r"(received\s+\d+|accepted\s+\d+|published\s+\d+|corresponding\s+author|©|copyright|creative\s+commons|open\s+access|email\s*:|e-mail\s*:)"
DATE_ONLY = r"^\s*(\d{4}\s*年\s*\d{1,2}\s*月|(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4})\s*$"
SUPPLEMENT_LICENSE = r"(supplement\s+(published|doi)|parent\s+article\s+doi|creative\s+commons\s+attribution|format\s+provided\s+by\s+the\s+authors\s+and\s+unedited|further\s+distribution\s+of\s+this\s+work)"
SUPPLEMENT_CONTENT = r"(architecture|implementation|training\s+data|experiment|method|results?|discussion|conclusion|网络结构|训练|实验|方法|结果|讨论|结论)"
NOISE_LINE = r"^\s*(\d+|page\s+\d+(\s+of\s+\d+)?|check\s*for\s*updates|checkfor|©\s*.+|copyright\s+.+|downloaded\s+from\s+.+|https?://\S+|www\.\S+|doi:\s*\S+)\s*$"
TITLE_NOISE = r"^\s*(check\s*for\s*updates|checkfor|updates|letter|article|research\s+article|paper|optics\s+letters)\s*$"
PLATFORM_METADATA = r"(citation:|view\s+online:|view\s+table\s+of\s+contents:|published\s+by\s+the|to\s+cite\s+this\s+article:|view\s+the\s+article\s+online\s+for\s+updates)"
RECOMMENDATION_HEADING = r"^\s*(articles\s+you\s+may\s+be\s+interested\s+in|you\s+may\s+also\s+like|related\s+content)\s*$"
ACADEMIC_HEADING = r"^\s*(((\d+|[ivxlcdm]+)\.?|[一二三四五六七八九十]+[、.]?)\s*)?(abstract|introduction|background|related\s+work|methods?|materials\s+and\s+methods|experiments?|experimental\s+setup|results?|discussion|conclusions?|acknowledg(e)?ments?|funding|摘要|引言|前言|相关工作|材料与方法|方法|实验结果|实验|结果与讨论|结果|讨论|结论|致谢|基金|资助)\s*$"
CITATION_NUMBERS = r"\s*\[[0-9,\-–—\s]+\]"
CITATION_AUTHORS = r"\s*\([A-Z][A-Za-z]+ et al\.,?\s+\d{4}[a-z]?\)"
GLYPHS = "锟銆鍏算鐵瀛骞渭娉搴杻妯"
ASSET_LABEL = r"\b(Figure|Fig\.|Table|Equation|Eq\.)\s*\d+[A-Za-z]?"
HEADING_NUMBER = r"^\s*(\d+(\.\d+)*|[ivxlcdm]+)\.?\s+"
COMMON_HEADING_NUMBER = r"^\s*([一二三四五六七八九十]+[、.]\s*|(\d+(\.\d+)*|[ivxlcdm]+|[a-z])\.?\s+)"
COMMON_HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods", "materials and methods", "experiments", "results", "discussion", "conclusion", "conclusions",
    "references", "bibliography", "acknowledgement", "acknowledgements", "参考文献", "摘要", "引言", "前言", "相关工作", "方法", "材料与方法", "实验", "结果", "讨论", "结论", "致谢",
)
REFERENCE_NAMES = ("references", "bibliography", "参考文献", "参考资料")

# Answers, markers and requests.
YES = ("yes", "true", "1", "relevant", "grounded", "useful")
VAGUE_REQUESTS = ("", "oct", "做个研究", "做研究", "研究", "调研", "文献", "检索", "综述", "deep research", "deep_research")
ITEM_PREFIXES = ("以下", "查询", "子问题")
FALLBACK_MARKERS = ("cannot be determined from the provided context", "provided context does not contain", "无法从提供的上下文", "知识库没有", "无法判断")

# Routes by keyword, in order of precedence.
ROUTES = {
    "self_rag": ("self_rag", "self-rag", "rag", "知识库", "知識庫", "本地检索", "本地檢索", "本地知识", "本地知識", "已索引", "论文库", "論文庫"),
    "strain_estimation": ("应变", "strain", "cnn", "bnn", "矢量", "vector", ".mat", "phase", "热力图"),
    "deep_research": ("deep research", "deep_research", "联网", "文献检索", "文献", "检索", "综述", "调研", "研究报告", "引用来源", "引用", "来源", "论文", "最新"),
}
KNOWLEDGE_WORDS = ("介绍", "简介", "是什么", "什么是", "什么叫", "解释", "讲讲", "讲解", "说说", "原理", "区别", "差异", "对比", "比较", "定义", "概念", "了解", "explain", "what is", "what are", "what's", "introduce", "definition", "define", "difference")
COMPUTE_WORDS = ("计算", "估计", "估算", "运算", "重建", "重构", "运行", "跑", "推理", "预测", "compute", "calculate", "run", "estimate", "estimation", "predict", "inference", "process", "reconstruct")


def py(pattern: str) -> str:
    """The pattern in Python's syntax."""
    import re

    return re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", pattern)
