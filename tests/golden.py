"""Inputs and results of the kernels, which must not change.

FRACTIONAL: d = 0.56, ten weights. SUPREMUM: windows of 15 to 13 samples, three lags, trend. SUMS: bound 1.5, samples 55 to 94 masked."""

nan = float("nan")

# fmt: off
FRACTIONAL_IN = [
    0.23575223, 0.89348613, 0.43196633, 0.86018474, 0.59765737, 0.02537023, 0.7332872, 0.4622992, 0.96278162, 0.33838066, 0.89851506, 0.90982346,
    0.54238173, 0.68145741, 0.95061314, 0.93442722, 0.2614748, 0.00405999, 0.75008525, 0.64118048, 0.32741177, 0.77945483, 0.10501869, 0.52248356,
    0.569884, 0.3254099, 0.2309258, 0.88311545, 0.5860409, 0.8447372, 0.81948561, 0.33338482, 0.30032552, 0.82731009, 0.68584524, 0.99592614,
    0.69919862, 0.88728765, 0.6370904, 0.25931114, 0.77664975, 0.00191125, 0.06043727, 0.81997762, 0.62892824, 0.08543346, 0.77194193, 0.93350418,
    0.41672853, 0.89452214, 0.9859954, 0.23336376, 0.50903137, 0.36534072, 0.36527723, 0.51881977, 0.38566805, 0.59163601, 0.8162303, 0.48761801,
    0.05340729, 0.80001708, 0.86127951, 0.72706986, 0.36959402, 0.11954723, 0.00799683, 0.56896299, 0.40747309, 0.50314072, 0.31325538, 0.3277913,
    0.75168065, 0.61296086, 0.16180291, 0.53711416, 0.37934352, 0.36650789, 0.22024702, 0.52589008, 0.12388826, 0.87836527, 0.20104567, 0.77184266,
    0.28660699, 0.40697238, 0.11326645, 0.43511667, 0.96272681, 0.60386761, 0.01621923, 0.04200219, 0.93858386, 0.88837139, 0.20881766, 0.77023781,
    0.30574534, 0.74073346, 0.62654889, 0.64183077,
]

FRACTIONAL_OUT = [
    -0.35131172, 0.49928454, 0.25017423, -0.17289674, 0.15147366, 0.37461599, 0.1987023, -0.49814806, -0.39431162, 0.57265172, 0.10862605,
    -0.19898058, 0.42240801, -0.4724218, 0.28296601, 0.16482447, -0.12555987, -0.09936503, 0.62507281, -0.01262697, 0.34505668, 0.17906916,
    -0.32295314, -0.1007382, 0.49591081, 0.08619913, 0.42358569, -0.05327547, 0.26209244, -0.07781242, -0.33216276, 0.41951532, -0.5924319,
    -0.13944678, 0.6705722, 0.0858732, -0.42139628, 0.56218567, 0.40226974, -0.26175034, 0.4584858, 0.3245855, -0.52701549, 0.13536349, -0.08450255,
    -0.00425219, 0.16583032, -0.04016165, 0.23173595, 0.35197123, -0.11896925, -0.40198151, 0.60707809, 0.31157253, 0.07938527, -0.23780636,
    -0.28918318, -0.22134125, 0.45148736, 0.01694105, 0.1555569, -0.09026478, 0.02155778, 0.45794614, 0.0894013, -0.33406492, 0.28526841, -0.03589293,
    0.01742604, -0.11140591, 0.282847, -0.26990253, 0.68218233, -0.37655569, 0.49942645, -0.25859327, 0.08411683, -0.24043617, 0.24573357, 0.62889871,
    -0.04567096, -0.50740424, -0.13925831, 0.81331429, 0.2939484, -0.45141761, 0.45552484, -0.26285934, 0.38984909, 0.07518225, 0.11830923,
]

SUPREMUM_IN = [
    56097, 55298, 56865, 56653, 57348, 57701, 57669, 58005, 56534, 56754, 57829, 59265, 59365, 58546, 58600, 59083, 59806, 59962, 59921, 59147, 59956,
    60646, 61723, 61927, 62312, 62386, 62486, 62953, 62904, 62770, 63072, 64567, 64593, 65217, 65224, 65917, 65831, 65530, 63998, 65692, 65039, 65368,
    66142, 66204, 65820, 65943, 65241, 65959, 65812, 66810, 67782, 66964, 65114, 66017, 66908, 66704, 66385, 68394, 68257, 67749, 67684, 67730, 67296,
    66860, 65828, 65813, 66685, 66037, 65079, 64872, 64511, 65216, 64284, 63529, 63691, 62923, 61738, 61293, 63058, 62106, 61955, 62699, 63010, 62618,
    62494, 61539, 61971, 61750, 62198, 61691, 61820, 62424, 62104, 60821, 61220, 60365, 59786, 59702, 59445, 57540, 56238, 55888, 54038, 54513, 56590,
    55039, 54619, 54063, 54463, 55213, 54633, 53798, 54490, 53403, 53417, 52481, 54156, 54430, 54001, 55049, 55651, 55352, 56105, 56195, 57195, 57167,
    55505, 55440, 53805, 53837, 53109, 52652, 54355, 54693, 55780, 56077, 56379, 55394, 53706, 53569, 53421, 54331, 53402, 53909, 54583, 55347, 54195,
    53034, 52639, 52608,
]

SUPREMUM_OUT = [
    -1.21135693, -1.43946329, -1.68232564, -0.906640237, -1.22108498, -0.189698401, -1.61136884, -2.07922055, -1.47889062, -0.154500897, 0.319911696,
    0.087868922, -1.47921599, -1.86779454, -0.606307399, 0.257244375, -1.14334838, -1.18730249, -1.71506619, -0.647773148, -0.104807511, -0.787479853,
    -1.25817874, -1.49762514, 0.860342121, -0.000147008814, -0.301985088, -0.628367474, -1.60387453, -1.60768983, -1.39444175, -1.49552296,
    -2.15359997, -1.33201221, -1.81103167, -2.28677615, -2.14815579, -2.44999544, -2.46165201, -1.9411655, -2.40810728, -1.33043296, -1.38970916,
    -1.48910285, -1.66342974, -0.867434354, -1.2962279, -1.21606999, -0.545470444, -0.026997128, 0.505580571, 0.136449876, -1.08418823, -1.49865579,
    -1.61797853, -2.24710713, -2.34719591, -3.07444659, -3.18648781, -3.59555532, -4.32738401, -4.40975161, -0.74521546, -0.238555156, -1.4037929,
    -1.58752257, -0.880635844, -0.550424848, -0.158852384, -0.403429076, -0.974086686, -2.14892913, -0.25934747, -0.426148831, -1.17506539,
    -1.16422279, -1.70821469, -1.02379456, -1.11480813, -1.64664715, -1.40974294, -0.496134128, 0.204860811, -0.363199833, -0.808995754, -0.249130799,
    -0.262068776, 0.483203541, 1.02040844, -0.701105404, -2.63805879, -2.64598113, -2.95255525, -4.56142359, -1.17970784, -1.47220169, -1.93733325,
    -2.61218996, -4.2899729, -3.82756132, -2.19426689, -0.933211928, -1.6394624, -1.49839818, -1.05623747, -0.383544039, -0.158982535, -0.655848188,
    -0.898149304, -2.32552512, -2.64714236, -2.23722131, -1.62003934, -0.481141227, 0.862839722, -0.458048141, -0.821320403, -1.0586779, -2.55349116,
    -1.5469969, -0.848539009, -1.85618615, -2.15178528, -2.18635148, -2.29839341, -2.78491273, -2.10545655, -2.46073525, -1.26924919, -1.83844315,
    -1.6332512, -0.309571763, -1.1271225, -1.25302114, -1.27289258, -0.546270441,
]

SUMS_IN = [
    0.129018739, -0.0372868106, 0.0803665072, 0.113388896, 0.211405158, -1.87389302, -1.49298251, -0.367588133, 0.18502301, 1.37755489, 1.94471419,
    2.02779365, 0.779438198, 0.875312984, -0.0891449675, -0.751767457, -2.68092918, -0.0124713015, -0.80605638, 1.11172998, 1.50093794, 1.06444263,
    0.612410843, -0.411053836, -1.16459882, -0.915333807, -1.59840739, -1.95039451, -1.77875793, -1.48031354, -1.4363004, -1.08606124, -1.35706651,
    -1.29983497, -1.34431458, -1.09004354, -0.236512214, -0.822312891, -1.58157325, -0.92301017, -1.04412234, -1.25493813, -1.415272, -0.957051098,
    -0.996711016, -0.190293401, -0.274390996, -0.556135952, -0.843288779, -1.51556408, -0.895729721, -1.02896595, -1.0885849, -0.515372515,
    0.0227763373, 0.12583217, 0.326305062, -0.377074569, -0.483075708, 0.108749524, 0.294588685, 1.06928301, 1.7073195, 1.29427803, 0.00249867584,
    0.428516775, -0.538754463, -0.909344018, -1.67661929, -1.83686483, -2.01971841, -2.11905456, -1.26595163, -0.861423373, -1.05872786, -0.903169811,
    -0.558466256, -1.28801656, -1.26653564, -0.797035813, -1.05585408, 0.244350776, 0.981386125, 0.581563473, 0.413042367, 1.43541145, 1.77149022,
    1.82967317, 2.2669003, 0.483456701, -1.44588661, -0.95796299, -1.20314801, -0.991502404, -1.55784547, -2.152951, -2.38276124, -1.00244188,
    -0.605904102, 0.0064116898, 0.203695863, 0.415354103, -0.38086018, -0.72654289, -0.811517417, -1.2369777, -0.692515969, -0.793053448,
    -0.141065717, -0.0508833416, 0.470857143, 0.471359283, -1.10454559, -1.36302245, -1.26677775, -1.3957839, -1.35328066, -0.965200126, -2.13306904,
    -2.48041272, -2.66801286, -2.98874855, -2.97862577, -2.77002382, -2.9213357, -3.24340367, -3.59914637, -2.41213465, -1.13178456, -1.09764194,
    -1.41129303, -1.51124787, -1.39209521, -1.41107309, -1.35771084, -0.928762376,
]

SUMS_OUT = [
    nan, 0, 0, 0, 0, -1, 0, 1, 0, 1, 0, 0, 0, 0, -1, 0, -1, 1, 0, 1, 0, 0, 0, -1, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 1, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1, 0, -1, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0,
]
