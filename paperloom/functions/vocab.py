"""Labels, words and tables that results depend on. Plain data, so that other languages can be added."""

from __future__ import annotations

#: JavaScript white space, as a Java and Python character class.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
NOT_WS = "[^" + WS[1:]

#: Labels of the facts that are read from documents, by kind.
FACT_LABELS = {
    "bidder_name": ["投标人", "投标单位", "供应商", "申请人"],
    "project_name": ["项目名称", "工程名称", "采购项目"],
    "project_number": ["项目编号", "招标编号", "标段编号", "项目代码"],
    "section_name": ["标段名称", "标段"],
    "duration": ["工期", "服务期", "交货期", "合同期限"],
    "quality": ["质量标准", "质量要求", "验收标准"],
    "role": ["招标人", "招标单位", "采购人"],
}
#: What a value may hold, by kind, and the word that may follow a bidder's label.
FACT_VALUES = {"project_number": "[A-Za-z0-9\\-_/]+", "other": "[^\\n,，;；]+"}
FACT_NAME = {"bidder_name": "名称"}
LEDGER_KINDS = ["project_name", "project_number", "section_name", "duration", "quality"]
#: Display names of the kinds, in the order of the local summary.
SUMMARY_KINDS = {"project_name": "项目名称", "project_number": "项目编号", "section_name": "标段", "duration": "工期/服务期", "quality": "质量标准", "role": "招标人"}
COMPARED = {"project_number": "项目编号", "project_name": "项目名称", "section_name": "标段名称", "duration": "工期/服务期/交货期", "quality": "质量标准"}

#: Synonyms of known template fields.
FIELD_SYNONYMS = {
    "bidderName": ["投标人名称", "投标单位名称", "投标人全称", "投标单位全称", "企业名称", "单位名称", "申请人名称", "投标人", "投标单位", "Bidder Name", "Bidder"],
    "unifiedSocialCreditCode": ["统一社会信用代码", "信用代码", "Unified Social Credit Code"],
    "address": ["地址", "注册地址", "企业地址", "详细地址", "Address"],
    "legalRepresentative": ["法定代表人", "法人代表", "Legal Representative"],
    "authorizedRepresentative": ["授权代表", "委托代理人", "授权委托人"],
    "contact": ["联系人", "项目联系人", "Contact Person", "Contact"],
    "phone": ["联系电话", "手机号码", "电话", "手机", "Telephone", "Phone", "Tel"],
    "email": ["电子邮箱", "电子邮件", "邮箱", "E-mail", "Email"],
    "projectName": ["项目名称", "工程名称", "Project Name"],
    "sectionName": ["标段名称", "标段"],
    "compilationDate": ["编制日期", "编制时间"],
    "duration": ["工期", "服务期", "交货期", "合同期限"],
    "qualityStandard": ["质量标准", "质量要求", "验收标准"],
    "projectNumber": ["项目编号", "招标编号", "标段编号", "项目代码"],
}
FORM_FIELDS = [f for f in FIELD_SYNONYMS if f not in ("duration", "qualityStandard", "projectNumber")]
FIXED_FIELDS = {"duration": "duration", "quality": "qualityStandard", "project_number": "projectNumber"}

#: What stands in a slot that is still empty.
EMPTY_SLOT = "(?:[_＿.．·…]{2,}|[-—–]{2,}|待填写|请填写|请提供|填写|空白|未填写|未提供|<[^>]+>|\\[\\[[^\\]]+\\]\\]|【[^】]+】)"
BLANK_CELL = "^(?:" + WS + "*|_+|待填写|请填写|\\[\\[.+?\\]\\])\\z"
PLACEHOLDER = "____+|待填写|请填写|\\[\\[.+?\\]\\]|示例(?:文本|单位|公司)?"
LEFTOVER = "\\[\\[.+?\\]\\]|____+|待填写|请填写"
FIXED_BLANK = "____+|待填写|请填写|\\[\\[.+?\\]\\]|【请填写"
REQUIRED = "资格|投标函|报价|承诺"
TEMPLATE_TITLE = "(?iu)投标文件格式|招标投标[^，。；\\n]{0,12}文件格式|资格(?:预|送|后)?审|资格标|投标文件组成|附件格式|qualification" + WS + "+(?:review|template)|tender" + WS + "+(?:document" + WS + "+)?format"
SECTION_SUFFIX = "(?:投标文件格式|资格审查|资格标|投标文件组成|附件格式|投标人须知|评标办法|合同条款|技术要求)\\z"
NUMBERING = "^(?:第" + WS + "*[0-9一二三四五六七八九十百]+" + WS + "*[章节部分篇]|[一二三四五六七八九十]+[、.．]|\\d+(?:\\.\\d+){0,5}(?:[、.．]|" + WS + "))"
PDF_SECTION = "(?iu)^(?:qualification" + WS + "+(?:template|document" + WS + "+)?format|资格审查|投标文件格式|投标文件组成|附件格式)"
PDF_NUMBERING = "^(?:第" + WS + "*[0-9一二三四五六七八九十百]+" + WS + "*[章节部分]|[一二三四五六七八九十]+[、.．]|\\d+(?:\\.\\d+){0,5})" + WS + "*"
IMAGE_MARKER = "(?:\\[\\[|【请插入[：:]?)(图片|证照|签章|印章|照片)(?:\\]\\]|】)"

#: What ends a value behind a label, and what stands for an image, in templates that are filled.
SEPARATOR = "[；;，,\\n]"
MARKER = "(?:\\[\\[(?:图片|证照|签章|印章|照片)[^\\]]*\\]\\]|【请插入[：:]?(?:图片|证照|签章|印章|照片)】)"
PLACEHOLDER_NAMES = {"image": "图片", "certificate": "证照", "signature": "签章", "stamp": "印章", "text": "文字"}

#: Task states and the changes between them that are allowed.
TRANSITIONS = {
    "created": ["previewing", "failed", "cancelled"],
    "previewing": ["previewing", "awaiting-confirmation", "failed", "cancelled"],
    "awaiting-confirmation": ["running", "failed", "cancelled"],
    "running": ["running", "verifying", "failed", "cancelled"],
    "verifying": ["verifying", "completed", "failed", "cancelled"],
    "completed": [],
    "failed": [],
    "cancelled": [],
}
#: Bounds of the custom integer types.
INTEGER_BOUNDS = {
    "i1": (-(2**7), 2**7 - 1), "i2": (-(2**15), 2**15 - 1), "i4": (-(2**31), 2**31 - 1), "int": (-(2**31), 2**31 - 1), "i8": (-(2**63), 2**63 - 1),
    "ui1": (0, 2**8 - 1), "ui2": (0, 2**16 - 1), "ui4": (0, 2**32 - 1), "uint": (0, 2**32 - 1), "ui8": (0, 2**64 - 1),
}
