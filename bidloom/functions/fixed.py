"""Word lists, patterns and constants that define results. All are fixed values."""

# Terms of a page's technical or commercial part, by how often they are counted.
TECHNICAL_TERMS = (
    "技术标 技术部分 技术方案 施工组织设计 施工方案 施工组织 技术措施 主要施工方法 工程概况 项目概况 总体概述 项目管理 质量保证 安全保证 工期保证 施工部署 "
    "施工进度 资源配置 主要机械 劳动力安排 项目概述 项目背景 需求分析 功能需求分析 系统设计 实施方案 测试方案 售后服务及培训方案"
).split()
COMMERCIAL_TERMS = (
    "商务标 商务部分 投标报价 报价表 工程量清单 报价汇总 投标总价 单项报价 分项报价 报价文件 商务文件 价格文件 报价书 报价说明 清单报价 投标价格 投标函 "
    "投标书 授权委托书 开标一览表 投标分项报价表 合同条款偏离表 采购需求偏离表 资格证明资料 投标保证金 业绩合同 中标服务费承诺书"
).split()
# Terms that mark a title as technical or commercial.
TECHNICAL_TITLES = "技术标 技术部分 技术方案 施工组织设计 项目概述 项目背景 功能需求分析 系统设计".split()
COMMERCIAL_TITLES = "商务标 商务部分 投标报价 工程量清单 报价文件 报价书 投标书 开标一览表 投标分项报价表 资格证明资料 授权委托书".split()

# Boilerplate terms, in the order in which alternatives are tried.
BOILERPLATE = (
    "测试过程 操作步骤 期望结果 评估准则 测试结果与预期 验收标准 验收条件 测试方法 测试用例 检查测试结果 "
    "投标人应具备 投标人承诺 服务承诺 售后服务 项目合同期内 验收后 维护期内 质量保证期 稳定性和安全性 提供技术服务 现场或远程 技术支持服务 BUG 修复 运行异常处理 响应 "
    "符合招标文件 满足招标 无偏离 完全响应 正偏离 招标文件要求 技术规格 商务条款 采购文件要求 响应招标文件 响应采购文件 按照招标文件 严格按照 采购人要求 招标人要求 本项目要求 本项目 "
    "序号 项目名称 规格型号 技术参数 备注 投标人名称 法定代表人 授权代表 盖章 签字 日期 联系人 联系电话 "
    "质量保证体系 安全管理 环境保护 文明施工 项目管理 进度计划 资源配置 人员配备 施工方案 施工组织设计 施工组织 确保质量 确保安全 按时完成 保质保量 法律法规"
).split()
# Terms that make a paragraph specific.
MARKERS = "型号 设备 品牌 参数 编号 节点 工期 人员 岗位 证书 系统 模块 接口 数据库 算法 流程 清单 报价 金额 数量 规格".split()
# Characters that are confused with one another.
CONFUSABLE = "日曰 己已 末未 土士 干千 人入 天夭 王玉 戍戌 概慨 拨拔 析折 准淮 贷货 辨辩 燥躁 侯候 拦栏 历厉 睛晴 徒徙 茶荼".split()
# Words in front of a company name that say it is the tendering side's.
TENDERING = "招标人 招标单位 招标代理 招标机构 招标公司 业主 建设单位 采购人 采购单位 项目业主 发包人 委托方 甲方 招标方 项目招标人 项目单位 主管单位 监督单位".split()

# Thresholds.
SLOTS = 32
MIN_JACCARD = 0.10
EXACT_RATIO = 0.85
COSINE = 0.80
COSINE_SHORT = 0.90
SHORT = 100
TOP_PER_PAIR = 5000
COMMON_WORDS, SURE_COSINE = 0.20, 0.90
WEIGHT_MAX, WEIGHT_TOP, WEIGHT_MEAN, TOP_K = 0.40, 0.30, 0.20, 8
BOILERPLATE_WEIGHT = 0.3
TEMPLATE_RATIO, TEMPLATE_INFO = 0.55, 0.28
BLOCK_GAP, BLOCK_MIN, RUN_MIN = 2, 2, 3
TOC_SHARE = 0.2

# Patterns, in the syntax that Java and RE2 share.
MOBILE = r"1[3-9]\d{9}"
LANDLINE = r"0\d{2,3}[)-]\d{7,8}|\d{3,4}-\d{7,8}"
EMAIL = r"[\p{L}\p{N}_.\-+]+@[\p{L}\p{N}_.\-]+\.[a-zA-Z]{2,}"
CREDIT_CODE = r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}"
COMPANY = r"[一-龥()（）]{2,30}(?:有限公司|股份有限公司|有限责任公司|集团有限公司|集团公司|控股有限公司|实业有限公司|集团)"
CONTACT_NAME = r"(?:联系人|项目负责人|法定代表人|授权代表|技术负责人|投标人|委托代理人|被授权人|经办人|签字人|投标代表|技术总监|资深工程师)[：:]?[ \t]*([一-龥]{2,4})"
CONTACT_TABLE = r"(?:^|\s)([一-龥]{2,4})\s+(?:联系人|项目负责人|法定代表人|授权代表|技术负责人|投标人|项目经理|技术总监|资深工程师|测试主管|产品经理|负责人)"
TOC_ENTRY = r"([一-鿿A-Za-z0-9（）()《》、：:\-\s]{2,80}?)(?:[\.·•…\s_—-]{2,}|第?\s*)(\d{1,4})\s*页?\s*$"
TOC_FILL = r"[\.·•…_]{2,}"
# Characters that follow a name without being part of it.
NAME_TAIL = "的在是负有及与和这那了着负责整体项目进行"
# Words near which names of persons stand, words that are no names, and frequent surnames.
NAME_PLACES = "联系方式 联系人 项目团队 团队成员 项目人员 技术团队 管理团队 团队介绍 主要负责人 联系电话 手机号码".split()
NO_NAMES = (
    "联系方式 联系人 联系电话 手机号码 项目团队 团队成员 技术团队 管理团队 项目人员 主要负责人 联系地址 邮政编码 传真号码 电子邮箱 公司名称 统一社会信用 项目概况 "
    "总体概述 背景分析 建设目标 设计原则 总体架构 技术方案 系统设计 项目管理 总体设计 架构设计 质量管理 安全管理 网络架构 基础架构 核心功能 工程师 技术员 主管经理 副总经理 总经理 "
    "主管 经理 总监 部长 主任 组长 科长 处长 助理 专员 秘书 顾问 专家"
).split()
SURNAMES = "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢宋唐韩曹许邓冯萧程蔡彭潘袁董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭石贾邹熊孟秦薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严峻尹钱施牛洪龚"
VERSION = r"\d+\.\d+[\d.]*"
TITLE = r"^(?:[一二三四五六七八九十]+[、．.]|第[一二三四五六七八九十]+[章节部分条]|\d+[.．]|[（(]\d+[)）]|[A-Z][、．.]|[【\[(])"
LIST_ITEM = r"^(?:[\-—–*•●○□△]+|\d+[.．、)]+|[（(]\d+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]+|[a-z][、．)]+)"
TOC_LINE = (r"^第[一二三四五六七八九十百千\d]+[章节条]", r"^\d+(?:\.\d+)+\s+\S", r"^[（(]?[一二三四五六七八九十百千\d]+[）、.)]\s*\S", r"^目[ \t]*录\s*$")
MONEY = r"([\d,]+\.?\d*)\s*(万?)元"
