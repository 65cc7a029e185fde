"""Fixed values of the report format."""

# Results depend on them, they must not change.
THREAD_NAME = "Gecko"  # the thread whose hangs are analysed
PLUGIN_PREFIX = "IPDL::PPlugin"  # a frame starting with this is a plugin frame
REPORT_REASON = "saved-session"  # the only report kind that is selected
PREFIX_LENGTH = 37  # characters in front of the JSON body of a line
WILDCARD = "*"  # "any value" in a selection
FILES_PER_SLICE = 16  # files one read task should take
LINE_SUFFIX = r"\A(.*):[0-9].*\z"  # a frame with a trailing line number
SKIPPED_RANKS = 1  # hottest frames left out of the cluster report
LAST_RANK = 15  # last rank listed in the cluster report
STACKS_PER_FRAME = 3  # stacks listed for each frame
TOP_LIST = 10  # length of the plugin top lists

# Selection dimensions, in the order of the directory layout.
DIMENSIONS = (
    "reason",
    "appName",
    "appUpdateChannel",
    "appVersion",
    "appBuildID",
    "submission_date",
)
